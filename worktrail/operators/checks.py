"""Referential, uniqueness, split and inventory checks. Each returns issue rows, so that
many checks run as one union and one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.text import no_strings

ISSUE = ["project_id", "code", "subject", "target"]
# Keys that only the gold side may hold, and probe metadata never shown.
FORBIDDEN_KEYS = ["answer", "evidence", "expected_behavior", "gold", "memories", "memory_graph", "verifier_report"]
HIDDEN_METADATA = ["expected_behavior", "evidence", "gold", "answer", "must_include", "must_not_include"]


def issue(df: DataFrame, code: Column | str, subject: Column | str, target: Column | str = "") -> DataFrame:
    as_col = lambda v, lit: (F.lit(v) if lit else F.col(v)) if isinstance(v, str) else v
    return df.select(
        "project_id", as_col(code, True).alias("code"), as_col(subject, False).alias("subject"), as_col(target, target == "").alias("target")
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def exploded(df: DataFrame, column: str, *keep: str) -> DataFrame:
    return df.select("project_id", *keep, F.explode_outer(column).alias("target")).filter("target is not null")


def reference_integrity(
    events: DataFrame, artifacts: DataFrame, memories: DataFrame, memory_events: DataFrame, probes: DataFrame
) -> DataFrame:
    """References that lead nowhere inside their project."""
    artifact_refs = exploded(events, "artifacts", "event_id").distinct()
    known_artifacts = artifacts.select("project_id", F.col("artifact_id").alias("target"))
    event_ids = events.select("project_id", F.col("event_id").alias("target"))
    claims = exploded(events, "claims").distinct()
    invalid = exploded(events, "invalidates", "event_id")
    named = F.concat("evidence.positive", "evidence.negative", "evidence.obsolete", "evidence.distractor")
    probe_refs = exploded(probes.withColumn("refs", F.array_distinct(named)), "refs", "probe_id")
    memory_ids = memories.select("project_id", F.col("memory_id").alias("target"))
    sources = memory_events.select("project_id", "memory_id", F.col("event_id").alias("target")).distinct()
    on = ["project_id", "target"]
    return union_all(
        [
            issue(artifact_refs.join(known_artifacts, on, "left_anti"), "missing artifact", "event_id", "target"),
            issue(invalid.join(event_ids.unionByName(claims), on, "left_anti"), "invalidates unknown target", "event_id", "target"),
            issue(sources.join(event_ids, on, "left_anti"), "references missing source event", "memory_id", "target"),
            issue(probe_refs.join(memory_ids, on, "left_anti"), "references missing memory", "probe_id", "target"),
        ]
    )


def temporal_references(events: DataFrame) -> DataFrame:
    """Links to events that do not exist, or that lie later than the linking event."""
    known = events.select("project_id", F.col("event_id").alias("target"), F.col("ts").alias("target_ts"))
    parts = []
    for name in ("causal_links", "supersedes"):
        refs = exploded(events, name, "event_id", "ts").join(known, ["project_id", "target"], "left")
        code = F.when(F.col("target_ts").isNull(), f"{name} references missing event").when(
            F.col("target_ts") > F.col("ts"), f"{name} points to later event"
        )
        parts.append(issue(refs.withColumn("c", code).filter("c is not null"), F.col("c"), "event_id", "target"))
    return union_all(parts)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def set_difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys on one side only; none when both hold the same set."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right_only"))
    )


def split_consistency(members: DataFrame, manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """``members`` (project_id, split) from the split list, ``manifest`` (project_id, split,
    probes) and probe ``rows`` (project_id, split): one split per project everywhere, and
    as many rows as declared."""
    m = manifest.select("project_id", F.col("split").alias("m_split"), F.col("probes").alias("declared"))
    many = members.groupBy("project_id").agg(F.count_distinct("split").alias("n"), F.count("*").alias("rows"))
    joined = members.distinct().join(m, "project_id", "full_outer")
    counts = rows.groupBy("project_id").agg(F.count("*").alias("actual"))
    return union_all(
        [
            issue(many.filter("n > 1"), "project_in_multiple_splits", "project_id"),
            issue(many.filter("rows > 1"), "duplicate_split_project_id", "project_id"),
            issue(joined.filter("m_split is null"), "split_references_unknown_project", "project_id"),
            issue(joined.filter("split is null"), "split_missing_manifest_project", "project_id"),
            issue(joined.filter("split <> m_split"), "split_project_assignment_mismatch", "project_id"),
            issue(m.filter("m_split not in ('train', 'dev', 'test')"), "invalid_project_split", "project_id"),
            issue(rows.join(m, "project_id").filter("split <> m_split").select("project_id").distinct(), "probe_manifest_split_mismatch", "project_id"),
            issue(
                m.join(counts, "project_id", "left").filter("coalesce(actual, 0) <> declared"), "probe_count_per_project_mismatch", "project_id"
            ),
        ]
    )


def inventory_drift(recorded: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per recorded entry and field that differs now, or that is missing or new."""
    r = recorded.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("r"))
    c = current.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("c"))
    both = r.join(c, key, "full_outer")
    entry = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").alias("recorded"), F.col(f"c.{f}").alias("current"))
    presence = F.struct(
        F.lit("presence").alias("field"),
        F.when(F.col("r").isNotNull(), "present").alias("recorded"),
        F.when(F.col("c").isNotNull(), "present").alias("current"),
    )
    one_sided = F.col("r").isNull() | F.col("c").isNull()
    diffs = F.when(one_sided, F.array(presence)).otherwise(
        F.filter(F.array(*[entry(f) for f in fields]), lambda e: ~e["recorded"].eqNullSafe(e["current"]))
    )
    return both.select(key, F.explode_outer(diffs).alias("d")).filter("d is not null").select(key, "d.*")


def strip_gold(probes: DataFrame) -> DataFrame:
    """Public projection of probes: no evidence, no expected behaviour, clean metadata."""
    gold = ["must_include", "must_not_include", "evidence"]
    shown = F.map_filter("metadata", lambda k, v: ~k.isin(HIDDEN_METADATA)) if "metadata" in probes.columns else F.create_map().cast("map<string,string>")
    return probes.withColumn("metadata", shown).drop(*gold)


def forbidden_keys(df: DataFrame, name: str, key: str) -> DataFrame:
    """Gold keys among the columns of a table, and among the metadata keys of its rows."""
    top = sorted(set(df.columns) & set(FORBIDDEN_KEYS))
    found = F.array_sort(F.array_intersect(F.map_keys("metadata"), F.array(*[F.lit(k) for k in FORBIDDEN_KEYS])))
    rows = df.select(
        F.lit(name).alias("table"),
        F.col(key).cast("string").alias("row_key"),
        F.lit("|".join(top)).alias("top_level"),
        F.array_join(F.coalesce(found, no_strings()), "|").alias("in_metadata"),
    )
    return rows.filter("top_level <> '' or in_metadata <> ''")
