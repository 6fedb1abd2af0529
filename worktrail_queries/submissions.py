"""Submitted predictions and traces out of the conversations table: one conversation is a
trace, one turn a prediction or an action. Projects beyond the release, unknown probes,
duplicate ids and empty texts all occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.operators import projects as J  # noqa: F401
from worktrail_queries.inputs import read
from worktrail_queries.sqlkit import table

_PROBES = "'probe_gharchive_docs_pr_actions', 'probe_gharchive_pre_ci_merge_storage', 'probe_gharchive_cross_event_ci_policy', 'probe_unknown'"
_PROJECT = "concat('project_gharchive_org_repo_', (conv_id * 7) % 170)"
_TEXT = """CASE WHEN role = 'system' THEN ' ' WHEN turn % 3 = 0 THEN concat('Wait for CI, add a summary comment and request review. ', text)
  WHEN turn % 3 = 1 THEN concat('Do not store the human emergency merge, it is not assistant default. ', text)
  ELSE concat('The assistant may merge before CI by default, merge after CI success and review. ', text) END"""
_ACTION = """CASE turn % 6 WHEN 0 THEN 'add_summary_comment' WHEN 1 THEN 'wait_for_ci' WHEN 2 THEN 'merge before CI success' WHEN 3 THEN 'request_dev_1_review'
  WHEN 4 THEN 'merge_after_ci_success' ELSE 'suppress_blocked_workflow_as_agent_habit' END"""
_TOOL = "CASE role WHEN 'user' THEN 'GitHub' WHEN 'assistant' THEN 'ci' ELSE 'e-mail' END"

table(
    "subm",
    f"""SELECT conv_id * 1000 + turn AS row_no, 'pred_' || conv_id || '_' || (turn // 2) AS prediction_id, {_PROJECT} AS project_id,
  [{_PROBES}][CAST(1 + turn % 4 AS INTEGER)] AS probe_id, {_TEXT} AS prediction FROM conversations""",
)
table(
    "tracehead",
    f"SELECT DISTINCT 'trace_' || conv_id AS trace_id, {_PROJECT} AS project_id, [{_PROBES}][CAST(1 + conv_id % 4 AS INTEGER)] AS probe_id FROM conversations",
)
table(
    "actions",
    f"""SELECT 'trace_' || conv_id AS trace_id, 'a' || turn AS action_id, {_TOOL} AS tool, {_ACTION} AS action, text AS rationale, turn,
  turn % 2 = 0 AS approval_obtained, turn % 5 = 4 AS clarification_requested FROM conversations""",
)


table(
    "subret",
    """SELECT DISTINCT row_no, project_id, probe_id, event_id FROM (SELECT s.*, r.event_id FROM subm s JOIN req r USING (project_id, probe_id) WHERE (row_no + CAST(regexp_extract(r.event_id, '[0-9]+$') AS BIGINT)) % 3 > 0
  UNION ALL SELECT *, 'event_gone' FROM subm WHERE row_no % 2 = 0)""",
)
table("subhits", "SELECT row_no, count(*) AS n_found FROM subret JOIN req USING (project_id, probe_id, event_id) GROUP BY row_no")


def retrieved_ids(spark, sf, required: DataFrame) -> DataFrame:
    """Events that each submitted row names: two of three required ones, and an unknown one."""
    rows = submission(spark, sf).select("baseline", "row_no", "project_id", "probe_id")
    number = F.regexp_extract("event_id", "[0-9]+$", 0).cast("bigint")
    named = rows.join(required, ["project_id", "probe_id"]).filter((F.col("row_no") + number) % 3 > 0)
    gone = rows.filter("row_no % 2 = 0").withColumn("event_id", F.lit("event_gone"))
    return named.unionByName(gone).distinct()


def submission(spark, sf) -> DataFrame:
    """Predictions in file order (row_no), with the layout of a submission."""
    return read(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn as row_no",
        "concat('pred_', conv_id, '_', turn div 2) as prediction_id",
        f"{_PROJECT} as project_id",
        f"element_at(array({_PROBES}), cast(1 + turn % 4 as int)) as probe_id",
        f"{_TEXT} as prediction",
        "cast(array() as array<string>) as memory_ids",
        "'conversation_system' as baseline",
    )


def traces(spark, sf) -> tuple[DataFrame, DataFrame]:
    turns = read(spark, sf, "conversations")
    heads = turns.selectExpr(
        "concat('trace_', conv_id) as trace_id",
        f"{_PROJECT} as project_id",
        f"element_at(array({_PROBES}), cast(1 + conv_id % 4 as int)) as probe_id",
    ).distinct()
    actions = turns.selectExpr(
        "concat('trace_', conv_id) as trace_id",
        "concat('a', turn) as action_id",
        f"{_TOOL} as tool",
        f"{_ACTION} as action",
        "text as rationale",
        "map('turn', cast(turn as string)) as args",
        "turn % 2 = 0 as approval_obtained",
        "turn % 5 = 4 as clarification_requested",
    )
    return heads, actions
