"""Per-event predicates and per-repository counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.functions import signals as S
from worktrail.functions.ids import iso_seconds
from worktrail.operators import profile as P
from worktrail_queries.inputs import light
from worktrail_queries.registry import query
from worktrail_queries.sqlkit import COUNTS, MISSING, iso


def _predicate(name, flag, column):
    @query(name, f"SELECT event_id FROM fl WHERE {flag}")
    def run(spark, sf):
        return light(spark, sf).filter(column()).select("event_id")


_t, _c, _x = (lambda: F.col("event_type")), (lambda: F.col("claims")), (lambda: F.col("content"))
_predicate("pred_negative_boundary", "neg_text", lambda: S.negative_language(_x()))
_predicate("pred_emergency", "f_emerg", lambda: S.emergency(_x()))
_predicate("pred_merged_pr", "f_merge", lambda: S.merged_pr(_t(), _c(), _x()))
_predicate("pred_execution_boundary", "f_exec", lambda: S.execution_boundary(_t(), _c(), _x()))
_predicate("pred_summary_comment", "f_summary", lambda: S.summary_comment(_t(), _x()))
_predicate("pred_routing_instruction", "f_routing", lambda: S.routing_instruction(_t(), _x()))
_predicate("pred_type_in", "f_review", lambda: _t().isin(S.REVIEW))


@query(
    "group_negative_fallback",
    """SELECT repo, event_id FROM (SELECT *, bool_or(f_emerg) OVER (PARTITION BY repo) AS any_e FROM fl)
       WHERE CASE WHEN any_e THEN f_emerg ELSE f_neg END""",
)
def group_negative_fallback(spark, sf):
    return P.negative_fallback(light(spark, sf)).select("repo", "event_id")


@query("repo_signal_counts", f"SELECT repo, {COUNTS} FROM fl GROUP BY repo")
def repo_signal_counts(spark, sf):
    return P.signal_counts(light(spark, sf), "repo")


def _profile_columns(df):
    return df.select(
        "repo", *S.COUNT_FIELDS, F.array_join("missing_required_signals", "|").alias("missing_required_signals"), "eligible",
        iso_seconds(F.col("first_ts")).alias("first_timestamp"), iso_seconds(F.col("last_ts")).alias("last_timestamp"),
    )


@query(
    "repo_quality_profile",
    f"SELECT * EXCLUDE (first_ts, last_ts), {iso('first_ts')} AS first_timestamp, {iso('last_ts')} AS last_timestamp FROM prof",
)
def repo_quality_profile(spark, sf):
    return _profile_columns(P.quality_profile(light(spark, sf)))


RANK_COUNTS = COUNTS.replace(
    "CASE WHEN count(*) FILTER (f_emerg) > 0 THEN count(*) FILTER (f_emerg) ELSE count(*) FILTER (f_neg) END",
    "count(*) FILTER (f_emerg OR f_neg)",
)


@query("repo_rank_counts", f"SELECT repo, {RANK_COUNTS}, {iso('min(ts)')} AS first_timestamp, {iso('max(ts)')} AS last_timestamp FROM fl GROUP BY repo")
def repo_rank_counts(spark, sf):
    return P.rank_counts(light(spark, sf)).select(
        "repo", *S.COUNT_FIELDS, iso_seconds(F.col("first_ts")).alias("first_timestamp"),
        iso_seconds(F.col("last_ts")).alias("last_timestamp"),
    )


@query(
    "repo_rank",
    f"""WITH c AS (SELECT repo, {RANK_COUNTS}, min(ord) AS first_ord FROM fl GROUP BY repo),
      s AS (SELECT *, {MISSING} = '' AS eligible, CAST(least(pr_or_comment, 5) * 2 + least(review, 5) * 3 + least(execution_boundary, 5) * 2
        + least(negative_boundary, 5) * 3 + least(merge, 3) + least(actors, 5) AS BIGINT) AS score FROM c)
      SELECT repo, eligible, score, events, review, execution_boundary, negative_boundary FROM s
      ORDER BY eligible DESC, score DESC, events DESC, review DESC, execution_boundary DESC, negative_boundary DESC, first_ord LIMIT 100""",
)
def repo_rank(spark, sf):
    return P.rank_repos(light(spark, sf)).select(
        "repo", "eligible", F.col("score").cast("bigint").alias("score"), "events", "review", "execution_boundary", "negative_boundary"
    )
