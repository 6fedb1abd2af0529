"""Verification of projects: references, grounding, contracts and boundary alignment, for
all projects at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.functions.text import boundary_entry_matches, flatten_expected, no_strings
from worktrail.operators import checks as C
from worktrail.operators.scoring import _field, evidence_memories
from worktrail.schemas import BOUNDARY_FIELDS

#: Columns of events and artifacts that verification reads.
EVENT_COLUMNS = [
    "project_id", "event_id", "ts", "source_dataset", "actor", "event_type", "artifacts", "raw_pointer", "claims", "causal_links", "supersedes", "invalidates",
]
ARTIFACT_COLUMNS = ["project_id", "artifact_id"]
# Memory types that need a boundary, and the boundary lists that count.
POLICY_TYPES = [
    "user_policy", "work_habit", "workflow_routine", "contextual_policy", "policy_exception", "negative_policy_example",
    "authorization_boundary", "authorization_gap",
]
ACTIVE_FIELDS = [f for f in BOUNDARY_FIELDS if f not in ("conditions", "exceptions")]
FORBIDDING_FIELDS = ["forbidden_actions", "forbidden_tools", "requires_approval", "requires_clarification"]
MULTI_ACTOR_MARKERS = ["cross_tool_boundary", "routine_step_ordering"]
INVALIDATING_RELATIONS = ["invalidates", "supersedes", "obsolete"]
INVALIDATING_TYPES = ["negative_evidence", "invalidation", "correction"]
# Per task type (positive types, types anywhere, needs negative, needs
# distractor, needs invalidating, needs future use, source datasets, positive memories).
CONTRACTS = [
    ("implicit_policy_induction", ["user_policy"], [], False, False, False, True, 0, 1),
    ("policy_update_and_exception_handling", ["user_policy", "policy_exception"], [], False, False, False, True, 0, 2),
    ("cross_day_habit_generalization", ["work_habit"], [], False, False, False, True, 0, 1),
    ("routine_step_ordering", ["workflow_routine"], [], False, False, False, True, 0, 1),
    ("contextual_workflow_policy_selection", ["contextual_policy"], [], False, False, False, True, 0, 1),
    ("negative_example_storage_gating", ["negative_policy_example"], ["negative_policy_example"], True, False, True, False, 0, 1),
    ("tool_action_policy_alignment", [], [], False, False, False, True, 0, 1),
    ("privacy_authorization_boundary", ["authorization_boundary"], [], False, False, False, True, 0, 1),
    ("authorization_gap_clarification", ["authorization_gap"], [], False, False, False, True, 0, 1),
    ("artifact_management_habit_transfer", ["work_habit"], [], False, False, False, True, 0, 1),
    ("cross_tool_boundary_composition", [], [], True, True, False, False, 3, 3),
]
CONTRACT_SCHEMA = (
    "task_type string, positive_types array<string>, any_types array<string>, needs_negative boolean, needs_distractor boolean, "
    "needs_invalidating boolean, needs_future boolean, min_datasets int, min_positive int"
)


def _has_boundary():
    return F.exists(F.array(*[F.size(_field(f)) > 0 for f in ACTIVE_FIELDS]), lambda b: b)


def probe_support(probes: DataFrame, memory_events: DataFrame, events: DataFrame) -> DataFrame:
    """Actors and source datasets behind the positive memories of each probe."""
    each = probes.select("project_id", "probe_id", F.explode_outer("evidence.positive").alias("memory_id")).filter("memory_id is not null")
    rows = each.join(memory_events.select("project_id", "memory_id", "event_id"), ["project_id", "memory_id"]).join(
        events.select("project_id", "event_id", "actor", "source_dataset"), ["project_id", "event_id"]
    )
    return rows.groupBy("project_id", "probe_id").agg(
        F.count_distinct("actor").alias("actors"), F.count_distinct("source_dataset").alias("datasets")
    )


def contract_issues(
    probes: DataFrame, memories: DataFrame, memory_events: DataFrame, events: DataFrame
) -> DataFrame:
    """Structural contracts by task type, one issue per broken rule."""
    spark = probes.sparkSession
    contracts = spark.createDataFrame(CONTRACTS, CONTRACT_SCHEMA)
    turning = events.filter(
        (F.size("invalidates") > 0) | (F.size("supersedes") > 0) | F.col("event_type").isin(INVALIDATING_TYPES)
    ).select("project_id", "event_id")
    turned = (
        memory_events.join(turning, ["project_id", "event_id"], "left_semi")
        .select("project_id", "memory_id")
        .distinct()
        .withColumn("turned", F.lit(True))
    )
    rows = evidence_memories(probes, memories).join(turned, ["project_id", "memory_id"], "left")
    positive = F.col("role") == "positive"
    invalidating = (
        (F.size("negative_evidence") > 0)
        | F.exists("relations", lambda r: r["type"].isin(INVALIDATING_RELATIONS))
        | F.coalesce("turned", F.lit(False))
    )
    facts = rows.groupBy("project_id", "probe_id").agg(
        F.count_if(positive).alias("n_positive"),
        F.collect_set(F.when(positive, F.col("memory_type"))).alias("have_positive"),
        F.collect_set("memory_type").alias("have_any"),
        F.bool_or(positive & F.col("future_score").isNotNull()).alias("has_future"),
        F.bool_or(invalidating).alias("has_invalidating"),
    )
    base = (
        probes.join(F.broadcast(contracts), "task_type")
        .join(facts, ["project_id", "probe_id"], "left")
        .join(probe_support(probes, memory_events, events), ["project_id", "probe_id"], "left")
    )
    none, no = no_strings(), F.lit(False)
    lacks = lambda need, have: F.size(F.array_except(need, F.coalesce(have, none))) > 0
    broken = F.array_compact(
        F.array(
            F.when(F.coalesce("n_positive", F.lit(0)) < F.col("min_positive"), "too few positive memories"),
            F.when(lacks("positive_types", "have_positive"), "missing positive memory types"),
            F.when(lacks("any_types", "have_any"), "missing evidence memory types"),
            F.when(F.col("needs_negative") & (F.size("evidence.negative") == 0), "requires negative evidence"),
            F.when(F.col("needs_distractor") & (F.size("evidence.distractor") == 0), "requires distractor evidence"),
            F.when(F.col("needs_future") & ~F.coalesce("has_future", no), "requires future utility labels on positive evidence"),
            F.when(F.col("needs_invalidating") & ~F.coalesce("has_invalidating", no), "requires evidence grounded in an invalidating event"),
            F.when(F.coalesce("datasets", F.lit(0)) < F.col("min_datasets"), "too few supporting source datasets"),
        )
    )
    each = base.select("project_id", "probe_id", F.explode_outer(broken).alias("reason")).filter("reason is not null")
    return C.issue(each, "violates task contract", "probe_id", "reason")


def alignment_issues(probes: DataFrame, memories: DataFrame) -> DataFrame:
    """Expected behaviour has to reflect each positive memory's boundary, and to cover a
    forbidden entry where there is one."""
    text = flatten_expected(F.col("must_include"), F.col("must_not_include"))
    expected = probes.select("project_id", "probe_id", text.alias("expected"))
    rows = (
        evidence_memories(probes, memories)
        .filter(F.col("role") == "positive")
        .filter(_has_boundary())
        .join(expected, ["project_id", "probe_id"])
        .filter("expected <> ''")
    )
    every = F.concat(*[_field(f) for f in ACTIVE_FIELDS + ["conditions"]])
    forbidding = F.concat(*[_field(f) for f in FORBIDDING_FIELDS])
    found = lambda items: F.exists(items, lambda e: boundary_entry_matches(e, F.col("expected")))
    marked = rows.withColumn("reflected", found(every)).withColumn("has_forbidding", F.size(forbidding) > 0).withColumn("covered", found(forbidding))
    missed = C.issue(marked.filter(~F.col("reflected")), "does not reflect action boundary", "probe_id", "memory_id")
    covered = marked.groupBy("project_id", "probe_id").agg(F.bool_or("has_forbidding").alias("has"), F.bool_or("covered").alias("covered"))
    return missed.unionByName(C.issue(covered.filter("has and not covered"), "does not cover forbidden action boundary", "probe_id"))


def project_issues(
    events: DataFrame, artifacts: DataFrame, memories: DataFrame, memory_events: DataFrame, probes: DataFrame
) -> DataFrame:
    """Every issue of every project as (project_id, code, subject, target)."""
    sourced = memory_events.select("project_id", "memory_id").distinct()
    unsourced = memories.join(sourced, ["project_id", "memory_id"], "left_anti")
    distractor = (F.col("status") == "distractor") | (F.col("memory_type") == "distractor")
    negative = C.exploded(probes.withColumn("refs", F.col("evidence.negative")), "refs", "probe_id")
    wrong_negative = negative.join(
        memories.filter((F.col("memory_type") != "negative_evidence") & (F.size("negative_evidence") == 0)).select(
            "project_id", F.col("memory_id").alias("target")
        ),
        ["project_id", "target"],
    )
    names = F.lower(F.concat_ws(" ", "task_type", "capabilities"))
    multi = probes.filter(names.rlike("|".join(MULTI_ACTOR_MARKERS))).join(
        probe_support(probes, memory_events, events), ["project_id", "probe_id"], "left"
    )
    return C.union_all(
        [
            C.reference_integrity(events, artifacts, memories, memory_events, probes),
            C.temporal_references(events),
            C.issue(events.filter("raw_pointer is null or raw_pointer = ''"), "missing raw_pointer", "event_id"),
            C.issue(events.filter((F.col("source_dataset") != "synthetic_bridge") & (F.size("artifacts") == 0)), "has no artifacts", "event_id"),
            C.issue(unsourced.filter(F.col("status") == "active"), "active memory has no source events", "memory_id"),
            C.issue(unsourced.filter(~distractor), "non-distractor memory has no source events", "memory_id"),
            C.issue(memories.filter(F.col("memory_type").isin(POLICY_TYPES)).filter(~_has_boundary()), "missing action boundary", "memory_id"),
            C.issue(probes.filter(F.size("evidence.positive") == 0), "no positive evidence", "probe_id"),
            C.issue(probes.filter(F.size("must_include") + F.size("must_not_include") == 0), "missing expected_behavior", "probe_id"),
            C.issue(wrong_negative, "is not a negative-evidence memory", "probe_id", "target"),
            C.issue(multi.filter(F.coalesce("actors", F.lit(0)) < 2), "multi-actor policy evidence has fewer than two actors", "probe_id"),
            contract_issues(probes, memories, memory_events, events),
            alignment_issues(probes, memories),
        ]
    )


# Check names and the issue codes that fail them.
CHECKS = {
    "provenance_completeness": ["missing artifact", "missing raw_pointer", "has no artifacts"],
    "invalidation_targets_known": ["invalidates unknown target"],
    "temporal_relations_valid": [
        "causal_links references missing event", "supersedes references missing event", "causal_links points to later event",
        "supersedes points to later event",
    ],
    "memory_graph_grounding": [
        "references missing source event", "active memory has no source events", "non-distractor memory has no source events",
    ],
    "negative_evidence_links_valid": ["is not a negative-evidence memory"],
    "multi_actor_policy_coverage": ["multi-actor policy evidence has fewer than two actors"],
    "action_boundaries_present": ["missing action boundary"],
    "action_boundaries_aligned": ["does not reflect action boundary", "does not cover forbidden action boundary"],
    "evidence_sufficiency": ["no positive evidence", "references missing memory"],
    "task_contracts_valid": ["violates task contract"],
}


def verify_projects(issues: DataFrame, probes: DataFrame) -> DataFrame:
    """The check matrix: one row per project, passed only without any issue."""
    counted = issues.groupBy("project_id").agg(
        F.count("*").alias("issues"), *[F.count_if(F.col("code").isin(codes)).alias(name) for name, codes in CHECKS.items()]
    )
    shape = probes.groupBy("project_id").agg(
        F.bool_or(F.size("evidence.negative") > 0).alias("negative_evidence_present"),
        F.bool_or(F.size("evidence.distractor") > 0).alias("distractor_evidence_present"),
        (F.count_distinct("task_type") >= 3).alias("multi_task_coverage"),
        F.count("*").alias("probes"),
    )
    own = ["negative_evidence_present", "distractor_evidence_present", "multi_task_coverage"]
    out = shape.join(counted, "project_id", "left")
    for name in CHECKS:
        out = out.withColumn(name, F.coalesce(name, F.lit(0)) == 0)
    extra = sum((F.when(F.col(n), 0).otherwise(1) for n in own[1:]), F.when(F.col(own[0]), 0).otherwise(1))
    out = out.withColumn("issues", F.coalesce("issues", F.lit(0)) + extra)
    return out.withColumn("schema_validity", F.lit(True)).withColumn("passed", F.col("issues") == 0)


