"""Steps of the release gates are done once."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from worktrail_queries import gold as G
from worktrail_queries import reports_q as R


def test_gates_make_coverage_once_and_write_no_artifacts(spark, tmp_path, monkeypatch):
    kinds = ["click", "view", "purchase", "error", "signup"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i // 5 % 4, kinds[i % 5], 1.0, json.dumps({"k": i % 15})) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    docs = [(i, f"line {i}\nmay act", "en", f"s{i % 3}", 9) for i in range(50)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(i // 4, i % 4, "user", "text") for i in range(40)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    calls, made = [], R._taxonomy
    monkeypatch.setattr(R, "_taxonomy", lambda *a: calls.append(1) or made(*a))
    out = {r.domain: r for r in R.domain_gate_matrix(spark, str(tmp_path)).collect()}
    assert len(calls) == 1 and len(out) == 6
    held = vars(G.gold(spark, str(tmp_path)))
    assert "all_events" in held and "artifacts" not in held
    g = G.Gold(spark, str(tmp_path))
    assert {r.value: r.n for r in R._taxonomy(spark, str(tmp_path)).filter("dimension = 'artifact_type'").collect()} == {
        r.artifact_type: r.n for r in g.artifacts.join(g.probes.select("project_id").distinct(), "project_id", "left_semi").groupBy("artifact_type").agg(F.count("*").alias("n")).collect()
    }
