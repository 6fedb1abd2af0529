"""Row-wise work is done once a row, on all cores, and for asked tables only."""

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worktrail.functions import signals as N
from worktrail.functions import text as X
from worktrail.operators import annotation as A
from worktrail.operators import predictors as D
from worktrail.operators import projects as J
from worktrail.operators import retrieval as R
from worktrail.operators import scoring as S
from worktrail.operators import verify as V
from worktrail.operators.audits import line_context_lint
from worktrail.operators.profile import flag_signals
from worktrail.session import TASKS_PER_CORE, spread
from worktrail.sources import files
from worktrail.sources import manifest_projects as P
from worktrail_queries import annotation_q as Q
from worktrail_queries import audits_q as U
from worktrail_queries import checks_q as K
from worktrail_queries import gold as G
from worktrail_queries import retrieval_q as L
from worktrail_queries import sources_q as W
from worktrail_queries.sources_q import number_files, number_inventory


@pytest.fixture
def plain_session(spark):
    """The session without the setting that only local ones have."""
    asked = spark.conf.get("spark.worktrail.spread")
    spark.conf.unset("spark.worktrail.spread")
    yield spark
    spark.conf.set("spark.worktrail.spread", asked)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_table_of_few_splits_is_dealt_out(plain_session):
    rows = plain_session.range(1000).repartition(1)
    dealt = spread(rows)
    assert dealt.rdd.getNumPartitions() == TASKS_PER_CORE * plain_session.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    many = plain_session.range(1000).repartition(TASKS_PER_CORE * plain_session.sparkContext.defaultParallelism + 1)
    assert spread(many) is many


def test_number_files_have_many_writers(spark, tmp_path):
    rows = [(i, f"src{i % 4}", i % 7) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    path = number_files(spark, str(tmp_path))
    writers = {re.search("part-([0-9]+)", uri).group(1) for uri in files.file_inventory(spark, path, "*.txt").toPandas()["path"]}
    assert len(writers) > 1
    got = {r.name: r.bytes for r in number_inventory(spark, path).collect()}
    want = {}
    for i, source, n in rows:
        name = f"source={source}/thousand={i // 1000}/hundred={i // 100}/numbers.txt"
        want[name] = want.get(name, 0) + len(f"{i} {n}\n")
    assert got == want


def test_lines_are_split_once(spark):
    text = "may act\nfine\n\nmay act\nnever\nmay act"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    rows = line_context_lint(docs, "id", "text", {"act": "may act"}, ["never"])
    assert optimized(rows).count("split(") == 1
    assert sorted((r.id, r.line_no, r.allowed) for r in rows.collect()) == [(1, 1, False), (1, 4, True), (1, 6, True)]


def test_manifest_rows_are_parsed_once(spark):
    texts = [json.dumps({"memory_id": "m", "project_id": "p", "memory_type": "t", "content": "write a@example.org"}), json.dumps({"memory_id": "n"}), "no json"]
    rows = spark.createDataFrame([("p", t) for t in texts], "project_id string, memory string")
    whole, broken = P._parsed(rows, "memory", P._MEMORY, P.MEMORY_NEEDS, True)
    assert "regexp_replace" not in optimized(whole) + optimized(broken)
    assert [(r.memory_id, r.content) for r in whole.collect()] == [("m", "write [REDACTED_EMAIL]")]
    assert sorted(r.memory_id or "" for r in broken.select("r.memory_id").collect()) == ["", "n"]


def test_gold_writes_asked_tables_only(spark, tmp_path):
    shape = "event_id long, ts timestamp, user_id long, event_type string, props string"
    rows = spark.range(400).selectExpr("id", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id))", "id % 3", "element_at(array('click', 'view', 'purchase', 'signup', 'error'), int(id % 5 + 1))", "concat('{\"k\": ', id % 100, '}')")
    spark.createDataFrame(rows.collect(), shape).write.parquet(f"{tmp_path}/events.parquet")
    gold = G.gold(spark, str(tmp_path))
    assert gold.probes.count() > 0
    assert {"artifacts", "memories", "memory_events"}.isdisjoint(vars(gold))
    assert gold.artifacts is gold.artifacts and gold.artifacts.count() > 0


def test_needle_of_a_subsequence_is_read_once(spark):
    rows = [("merge after ci", "please merge it after the ci run"), ("ci merge", "merge ci"), ("", "x"), (None, "x"), ("a b", None), ("go", "")]
    df = spark.createDataFrame(rows, "phrase string, text string")
    found = df.select("phrase", X.ordered_subsequence(X.tokens(F.col("phrase")), X.tokens(F.col("text"))).alias("found"))
    assert optimized(found).count("phrase") <= 6
    assert [r.found for r in found.collect()] == [True, False, False, None, None, False]


def test_markers_are_searched_for_without_patterns(spark):
    texts = [*N.NEGATIVE_MARKERS, *[m.upper() + " now" for m in N.NEGATIVE_MARKERS], "", "all fine", None, "do\nnot", "rewind"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.negative_language(F.col("t")).alias("hit"))
    assert "RLIKE" not in optimized(rows).upper()
    for r in rows.collect():
        assert r.hit == (None if r.t is None else any(m in r.t.lower() for m in N.NEGATIVE_MARKERS)), r.t


def test_evidence_is_read_without_writing_whole_events(spark, tmp_path):
    spark.range(40).selectExpr(
        "id as event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts", "id % 2 as user_id",
        "element_at(array('click', 'view', 'purchase', 'error'), cast(1 + id % 4 as int)) as event_type", "1.0 as value", "concat('{\"k\": ', id % 10, '}') as props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    narrow, whole = G.Gold(spark, str(tmp_path)), G.Gold(spark, str(tmp_path))
    assert whole.all_events.count() == 40
    for name in ("evidence", "memory_events", "probes"):
        a, b = ([r.asDict(True) for r in getattr(g, name).collect()] for g in (narrow, whole))
        assert sorted(map(str, a)) == sorted(map(str, b)), name
    assert "all_events" not in narrow.__dict__ and "evidence_events" in whole.__dict__


@pytest.mark.parametrize("most", [0, 3, 512])
def test_question_words_travel_as_arrays_and_copies_count_once(spark, monkeypatch, most):
    words = [["a", "b"], ["a"], ["b", "c", "d"], ["x"], [], ["a", "b"], None]
    events = [(f"p{p}", f"e{i}", i, i // 2, words[i % 7]) for p in range(3) for i in range(30)] + [(None, "e0", 0, 0, ["a"])]
    shape = "project_id string, event_id string, ord long, t long, words array<string>"
    asked = spark.createDataFrame([("p0", "a"), ("p0", "b"), ("p1", "a"), ("p1", "b"), ("p1", "c"), ("p1", "d"), (None, "a")], "project_id string, word string")
    keyed = ["project_id", "event_id", "ord", "t"]
    monkeypatch.setattr(R, "VOCABULARY", most)
    base = spark.createDataFrame(events + events, shape)
    wanted = {"p0": {"a", "b"}, "p1": {"a", "b", "c", "d"}}
    truth = {(*e[:4], " ".join(sorted(wanted[e[0]] & set(e[4] or [])))) for e in events if wanted.get(e[0], set()) & set(e[4] or [])}
    met = R._signatures(base, asked, keyed)
    assert {tuple(r) for r in met.collect()} == truth
    first = R._first_distinct(met, ["project_id", "signature"], [F.desc("t"), F.asc("ord")], 2).collect()
    groups: dict = {}
    for row in sorted(truth, key=lambda r: (-r[3], r[2])):
        groups.setdefault((row[0], row[4]), []).append(row)
    assert sorted(map(tuple, first)) == sorted(r for g in groups.values() for r in g[:2])


@pytest.fixture
def event_folder(spark, tmp_path):
    kinds = ["click", "view", "purchase", "error", "signup"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i // 5 % 4, kinds[i % 5], 1.0, json.dumps({"k": i % 15})) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_queries_of_tasks_write_no_events_and_no_evidence(spark, event_folder):
    for query in (Q.annotation_tasks, Q.boundary_subset, U.audit_sample_pack):
        assert query(spark, event_folder).count() > 0
    assert "evidence" not in vars(Q.staged(spark, event_folder))
    assert not {"all_events", "artifacts"} & set(vars(G.gold(spark, event_folder)))


def test_texts_are_searched_for_signals_once(spark, event_folder):
    whole = G.Gold(spark, event_folder)
    want = J.project_evidence(whole.all_events)
    g = G.Gold(spark, event_folder)
    assert "content" not in g.evidence_events.columns
    assert flag_signals(g.evidence_events) is g.evidence_events
    assert "Contains(" not in optimized(J.project_evidence(g.evidence_events))
    assert sorted(map(str, g.evidence.collect())) == sorted(map(str, want.collect()))
    told = J.memory_events(want, whole.all_events)
    assert sorted(map(str, g.memory_events.collect())) == sorted(map(str, told.collect()))


def test_log_verification_and_project_tables_write_no_whole_events_before(spark, event_folder):
    for rows in (L.predict_full_log(spark, event_folder), K.verified(spark, event_folder), W.write_project(spark, event_folder)):
        assert rows.count() > 0
    g = G.gold(spark, event_folder)
    assert not {"all_events", "artifacts"} & set(vars(g))
    counts = {r.table: r.rows for r in W.write_project(spark, event_folder).collect()}
    events = g.events
    assert counts["events"] == events.count() and counts["artifacts"] == g.artifacts.count()
    log = sorted(map(tuple, D.full_log(g.log).collect()))
    assert log == sorted(map(tuple, D.full_log(events).collect())) and log
    told = V.project_issues(*g.checked, g.memories, g.memory_events, g.probes)
    want = V.project_issues(events, g.artifacts, g.memories, g.memory_events, g.probes)
    assert sorted(map(str, told.collect())) == sorted(map(str, want.collect()))


def test_probes_without_answers_are_not_made_ready(spark, event_folder):
    g = G.gold(spark, event_folder)
    first = g.probes.orderBy("project_id", "probe_id").limit(1).select("project_id", "probe_id")
    answers = first.unionByName(spark.createDataFrame([(None, "x"), ("gone", "x")], "project_id string, probe_id string"))
    assert [tuple(r)[:1] for r in S.asked(g.probes, answers).select("project_id").collect()] == [(first.first().project_id,)]
    rows = answers.selectExpr("'s' as baseline", "project_id", "probe_id", "'wait for CI' as prediction", "array('m') as memory_ids")
    named = S.required_events(g.probes, g.memory_events).join(first, ["project_id", "probe_id"]).selectExpr("'s' as baseline", "project_id", "probe_id", "event_id")
    scored = S.score_predictions(rows, named, g.probes, g.memories, g.memory_events)
    got = {r.project_id: (r.known, r.evidence_recall) for r in scored.collect()}
    assert got == {None: (False, 0.0), "gone": (False, 0.0), first.first().project_id: (True, 1.0)}
    assert "left semi" in optimized(scored).lower().replace("leftsemi", "left semi")


def test_evidence_from_records_equals_evidence_from_written_events(spark, event_folder):
    got = sorted(map(str, Q.staged(spark, event_folder).evidence.collect()))
    g = G.gold(spark, event_folder)
    assert not {"all_events", "artifacts"} & set(vars(g))
    want = sorted(map(str, A.evidence_rows(Q.staged(spark, event_folder).tasks, g.all_events, g.artifacts).collect()))
    assert got == want and got
    assert g.sources == (g.all_events, g.artifacts)
