"""Project construction from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.operators import projects as J
from worktrail_queries.gold import gold
from worktrail_queries.registry import query


@query(
    "project_batch",
    """SELECT repo, CASE WHEN reason IS NULL THEN project_id END AS project_id, reason IS NULL AS built, coalesce(reason, '') AS reason, events,
         CASE WHEN reason IS NULL THEN 4 ELSE 0 END AS memories, CASE WHEN reason IS NULL THEN 3 ELSE 0 END AS probes FROM pe""",
)
def project_batch(spark, sf):
    g = gold(spark, sf)
    return J.project_batch(g.evidence, g.all_events)


@query(
    "memory_table",
    """SELECT m.project_id, m.memory_id, memory_type, content, status, relations, array_to_string(negative_evidence, '|') AS negative_evidence,
         future_score, array_to_string(expected_tasks, '|') AS expected_tasks, array_to_string(allowed_actions, '|') AS allowed_actions,
         array_to_string(forbidden_actions, '|') AS forbidden_actions, array_to_string(conditions, '|') AS conditions,
         array_to_string(authorized_tools, '|') AS authorized_tools, coalesce(n, 0) AS source_events, first_event
       FROM mem m LEFT JOIN (SELECT project_id, memory_id, count(DISTINCT event_id) AS n, first(event_id ORDER BY pos) AS first_event FROM mem_ev GROUP BY ALL) e
         ON m.project_id = e.project_id AND m.memory_id = e.memory_id""",
)
def memory_table(spark, sf):
    g = gold(spark, sf)
    sources = g.memory_events.groupBy("project_id", "memory_id").agg(
        F.count_distinct("event_id").alias("n"), F.expr("min_by(event_id, pos)").alias("first_event")
    )
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return g.memories.join(sources, ["project_id", "memory_id"], "left").select(
        "project_id", "memory_id", "memory_type", "content", "status",
        F.array_join(F.transform("relations", lambda r: F.concat(r["type"], F.lit("="), r["target"])), "|").alias("relations"),
        joined("negative_evidence").alias("negative_evidence"), "future_score", joined("expected_tasks").alias("expected_tasks"),
        *[joined(f"action_boundary.{b}").alias(b) for b in ("allowed_actions", "forbidden_actions", "conditions", "authorized_tools")],
        F.coalesce("n", F.lit(0)).alias("source_events"), "first_event",
    )


@query(
    "probe_table",
    """SELECT project_id, probe_id, task_type, query, array_to_string(must_include, '|') AS must_include, array_to_string(must_not_include, '|') AS must_not_include,
         array_to_string(positive, '|') AS positive, array_to_string(negative, '|') AS negative, array_to_string(distractor, '|') AS distractor,
         array_to_string(capabilities, '|') AS capabilities, answer_type, array_to_string(metrics, '|') AS metrics, difficulty FROM probe""",
)
def probe_table(spark, sf):
    p = gold(spark, sf).probes
    joined = lambda c, n: F.array_join(c, "|").alias(n)
    return p.select(
        "project_id", "probe_id", "task_type", "query", joined("must_include", "must_include"), joined("must_not_include", "must_not_include"),
        joined("evidence.positive", "positive"), joined("evidence.negative", "negative"), joined("evidence.distractor", "distractor"),
        joined("capabilities", "capabilities"), "answer_type", joined("metrics", "metrics"), "difficulty",
    )
