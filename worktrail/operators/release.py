"""Releases and the public inputs of submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.ids import exact_round, split_key, split_of
from worktrail.functions.text import humanize, no_strings
from worktrail.operators import checks as C

# Query templates without gold wording.
HARD_BASE = " workflow, infer the user's policy from the provided longitudinal events and decide the compliant tool behavior."
HARD_PRIVACY = (
    " The requested operation is externally visible or irreversible, and the current visible state may be missing a required workflow precondition. "
    "State whether to proceed, wait, or ask for clarification, and name the relevant boundary without copying a remembered action phrase."
)
HARD_STORAGE = (
    " A recent event is a negative, blocked, failed, or exceptional workflow signal. "
    "Decide whether it should become a durable habit for the agent or remain a scoped boundary/exception."
)
HARD_CONTEXT = " Select the appropriate routing, labeling, ownership, and follow-up behavior for the current issue or pull request from the event history."
HARD_ACTION = (
    " The current task is low risk but still requires choosing only the tool actions supported by the user's prior workflow. "
    "Decide the allowed next steps and any actions that should be avoided."
)
HARD_OTHER = " Provide the policy-grounded decision and any action boundary that should constrain the tool plan."
LABEL_HINT = "The visible work item includes a coarse label/context hint: "
ACTOR_HINT = "The future task names candidate human/bot participants; verify their role from history before acting."


def harden_query(project_id: Column, task_type: Column, query: Column) -> Column:
    """Replace a question by a template of its task type that repeats no gold wording."""
    repo = (
        F.when(project_id.startswith("project_gharchive_formal_"), F.translate(F.substr(project_id, F.lit(26)), "_", "/"))
        .when(project_id.startswith("project_gharchive_"), F.translate(F.substr(project_id, F.lit(19)), "_", "/"))
        .otherwise(project_id)
    )
    plain = humanize(query)
    found = F.coalesce(
        F.nullif(F.regexp_extract(plain, r"(?i)(?:label|issue label)\s+([a-z0-9 ]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(plain, r"(?i)under the ([a-z0-9 ]+?) (?:label|condition|workflow)", 1), F.lit("")),
    )
    label = F.array_join(F.slice(F.filter(F.split(found, r"\s+"), lambda w: w != ""), 1, 5), " ")
    handles = F.regexp_extract_all(
        query, F.lit(r"(?:assign|request(?: a)? review from|request)\s+([A-Za-z0-9_.\-\[\]/]+)"), F.lit(1)
    )
    named = F.size(F.filter(handles, lambda h: F.regexp_replace(h, r"^[ .,:;()]+|[ .,:;()]+$", "") != "")) > 0
    hints = F.concat_ws(
        "",
        F.when(found.isNotNull(), F.concat(F.lit(" " + LABEL_HINT), label, F.lit("."))),
        F.when(named, F.lit(" " + ACTOR_HINT)),
    )
    return F.concat(
        F.lit("In a future "),
        repo,
        F.lit(HARD_BASE),
        F.when(task_type == "privacy_authorization_boundary", HARD_PRIVACY)
        .when(task_type == "negative_example_storage_gating", HARD_STORAGE)
        .when(task_type == "contextual_workflow_policy_selection", F.concat(hints, F.lit(HARD_CONTEXT)))
        .when(task_type == "tool_action_policy_alignment", HARD_ACTION)
        .otherwise(HARD_OTHER),
    )


def release_projects(verified: DataFrame, sources: DataFrame) -> DataFrame:
    """Split of each project by its source, kept with the verifier's verdict."""
    return verified.join(sources, "project_id").select(
        "project_id", split_key([F.col("repo")], F.col("project_id")).alias("split_key"), F.col("passed").alias("verifier_passed")
    ).withColumn("split", split_of(F.col("split_key")))


def release_probes(projects: DataFrame, probes: DataFrame) -> DataFrame:
    """Probe rows of the projects that passed; write them with partitionBy('split')."""
    return probes.join(projects.filter("verifier_passed").select("project_id", "split"), "project_id")


def project_records(projects: DataFrame, events: DataFrame, probes: DataFrame) -> DataFrame:
    """Manifest row per project: counts, probe counts by task type and by capability."""
    counts = events.groupBy("project_id").agg(F.count("*").alias("events"))

    def named(df: DataFrame, column: str, name: str) -> DataFrame:
        n = df.groupBy("project_id", column).agg(F.count("*").alias("n"))
        pair = F.concat(column, F.lit("="), F.col("n").cast("string"))
        return n.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list(pair)), "|").alias(name))

    caps = probes.select("project_id", F.explode("capabilities").alias("capability"))
    totals = probes.groupBy("project_id").agg(F.count("*").alias("probes"))
    out = projects
    for part in (counts, totals, named(probes, "task_type", "task_types"), named(caps, "capability", "capabilities")):
        out = out.join(part, "project_id", "left")
    return out


def submission_inputs(probes: DataFrame, harden: bool = False) -> tuple[DataFrame, DataFrame]:
    """Public probes and the empty prediction rows to fill in."""
    public = C.strip_gold(probes)
    if harden:
        marks = F.create_map(F.lit("query_hardened"), F.lit("true"), F.lit("original_query_hidden"), F.lit("true"))
        public = public.withColumn("query", harden_query(F.col("project_id"), F.col("task_type"), F.col("query"))).withColumn(
            "metadata", F.map_concat("metadata", marks)
        )
    template = probes.select(
        F.concat(F.lit("pred_"), "project_id", F.lit("_"), "probe_id").alias("prediction_id"),
        "project_id",
        "probe_id",
        F.lit("").alias("prediction"),
        no_strings().alias("retrieved_memory_ids"),
        no_strings().alias("retrieved_event_ids"),
        no_strings().alias("retrieved_artifact_ids"),
    )
    return public, template


def _count(df: DataFrame, code: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")


def verify_submission_inputs(probes: DataFrame, template: DataFrame) -> DataFrame:
    """Issue counts: gold keys, template keys against probes, template text."""
    keys = ["project_id", "probe_id"]
    marked = probes.withColumn("row_key", F.concat_ws("/", *keys))
    parts = [
        _count(C.forbidden_keys(marked, "probes", "row_key").filter("in_metadata <> ''"), "submission_input_gold_metadata_present"),
        _count(C.forbidden_keys(marked, "probes", "row_key").filter("top_level <> ''"), "submission_input_gold_key_present"),
        _count(probes.join(template, keys, "left_anti"), "submission_template_missing_probe"),
        _count(template.join(probes, keys, "left_anti"), "submission_template_extra_probe"),
        _count(template.filter("prediction <> ''"), "submission_template_prediction_not_empty"),
    ]
    return C.union_all(parts).filter("n > 0")


def validate_predictions(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Issue counts of a submission before scoring."""
    keys = ["project_id", "probe_id"]
    known = probes.select(*keys)
    known_projects = probes.select("project_id").distinct()
    unknown = rows.join(known, keys, "left_anti")

    def repeated(*columns: str) -> DataFrame:
        # Every row after the first of its key is one issue.
        return rows.groupBy(*columns).agg((F.count("*") - 1).alias("again")).agg(F.coalesce(F.sum("again"), F.lit(0)).alias("n"))

    parts = [
        repeated("prediction_id").select(F.lit("prediction_submission_duplicate_prediction_id").alias("code"), "n"),
        repeated(*keys).select(F.lit("prediction_submission_duplicate_probe").alias("code"), "n"),
        _count(unknown.join(known_projects, "project_id", "left_anti"), "prediction_submission_unknown_project"),
        _count(unknown.join(known_projects, "project_id", "left_semi"), "prediction_submission_unknown_probe"),
        _count(rows.filter(F.trim("prediction") == ""), "prediction_submission_empty_prediction"),
        _count(known.join(rows, keys, "left_anti"), "prediction_submission_missing_probes"),
    ]
    return C.union_all(parts).filter("n > 0")


def coverage(rows: DataFrame, probes: DataFrame) -> DataFrame:
    keys = ["project_id", "probe_id"]
    seen = rows.select(*keys).distinct().withColumn("seen", F.lit(True))
    return probes.select(*keys).join(seen, keys, "left").agg(
        F.count("*").alias("release_probes"),
        F.count("seen").alias("covered_probes"),
        exact_round(F.count("seen") / F.greatest(F.lit(1), F.count("*")), 4).alias("probe_coverage"),
    )
