"""Built-in predictors. A prediction is one row per probe; the ids it retrieved are a
long table (baseline, project_id, probe_id, event_id), since they may be many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.ids import iso_seconds
from worktrail.functions.profile_text import query_assignees, query_label
from worktrail.functions.text import humanize, normalize_text, str_array, tokens
from worktrail.operators import retrieval as R
from worktrail.operators.ordering import group_positions, joined_list

# Texts of the predictors.
NO_MEMORY = (
    "No durable user policy or work history was retrieved. The agent should ask for clarification before taking externally visible, "
    "irreversible, or privacy-sensitive actions."
)
NO_MEMORY_INPUT = (
    "No user-specific policy memory was induced from the supplied submission input. The agent should ask for clarification before taking "
    "irreversible, externally visible, or privacy-sensitive actions."
)
FULL_LOG = "Full event-log baseline: raw chronological history, without induced policy memory."
RAW = "Raw-RAG retrieved evidence."
TEMPORAL = "Temporal Raw-RAG retrieved evidence with recency/update metadata, but without gold policy memory."
RAW_INPUT = "No-gold raw-event RAG baseline."
TEMPORAL_INPUT = "No-gold temporal raw-event RAG baseline."
ORACLE = "Oracle policy graph answer."
PROFILE = "No-gold event-profile memory baseline."
PROFILE_FALLBACK = (
    "Induced policy/action profile: use the retrieved workflow events conservatively; ask for clarification before irreversible, externally "
    "visible, or privacy-sensitive actions."
)
NEGATIVE_LINES = [
    "Allowed actions: suppress blocked workflow as agent habit; treat blocked workflow signal as a boundary for the workflow.",
    "Forbidden actions: do not store blocked or failed action as default habit; do not treat a blocked workflow signal as a default habit.",
]
MERGE_LINES = [
    "Allowed actions: respect execution boundary; merge after observed boundary conditions; wait until observed boundary conditions are present.",
    "Forbidden actions: do not merge without boundary check; do not ignore the execution boundary.",
]
TRIAGE_LINES = [
    "Authorized tools: github; issue_tracker.",
    "Forbidden actions: do not close without triage owner; do not escalate without triage context.",
]
BOUNDARY_LINES = [
    ("Allowed actions: ", "allowed_actions", True),
    ("Forbidden actions: ", "forbidden_actions", True),
    ("Requires approval: ", "requires_approval", True),
    ("Requires clarification: ", "requires_clarification", True),
    ("Authorized tools: ", "authorized_tools", False),
    ("Forbidden tools: ", "forbidden_tools", False),
]
#: Columns of events that a log is made of.
LOG_COLUMNS = ["project_id", "ts", "ord", "event_id", "event_type", "content", "artifacts"]
PREDICTION_COLUMNS = ["baseline", "project_id", "probe_id", "prediction_id", "prediction", "memory_ids"]


def _prediction(df: DataFrame, baseline: str, text: Column, memory_ids: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(baseline).alias("baseline"),
        "project_id",
        "probe_id",
        F.concat(F.lit("pred_"), "project_id", F.lit("_"), "probe_id").alias("prediction_id"),
        text.alias("prediction"),
        (memory_ids if memory_ids is not None else F.array().cast("array<string>")).alias("memory_ids"),
    )


def no_memory(probes: DataFrame, public: bool = False) -> DataFrame:
    return _prediction(probes, "no_memory_input" if public else "no_memory", F.lit(NO_MEMORY_INPUT if public else NO_MEMORY))


def full_log(events: DataFrame) -> DataFrame:
    """The whole history of a project in time order, one row per line. The log of a
    project has no size bound, so it is never put together into one value."""
    placed = group_positions(events.select("project_id", "ts", "ord", "event_id"), ["project_id"], ["ts", "ord"])
    lines = events.select(
        "project_id",
        "event_id",
        F.col("artifacts")[0].alias("artifact_id"),
        F.concat(iso_seconds(F.col("ts")), F.lit(" "), "event_id", F.lit(" "), "event_type", F.lit(": "), "content").alias("line"),
    )
    return placed.select("project_id", "event_id", "pos").join(lines, ["project_id", "event_id"])


def full_log_answers(events: DataFrame, probes: DataFrame) -> DataFrame:
    """A row without text per probe of a project with events: its answer is the whole log,
    which full_log() has as lines and full_log.score_release() scores where it is."""
    logged = probes.join(events.select("project_id").distinct(), "project_id", "left_semi")
    return _prediction(logged, "full_event_log", F.lit(None).cast("string"))


def from_retrieval(hits: DataFrame, events: DataFrame, baseline: str, head: str, line: Column) -> tuple[DataFrame, DataFrame]:
    """Prediction text out of the k retrieved events of each probe, and their ids."""
    rows = hits.join(events, ["project_id", "event_id"]).withColumn("line", line)
    joined = rows.groupBy("project_id", "probe_id").agg(joined_list(F.col("rank"), F.col("line")).alias("lines"))
    text = F.concat_ws("\n", F.lit(head), F.col("lines"))
    retrieved = hits.select(F.lit(baseline).alias("baseline"), "project_id", "probe_id", "event_id", "rank")
    return _prediction(joined, baseline, text), retrieved


def _annotated(with_validity: bool) -> Column:
    listed = lambda name: F.when(F.size(name) > 0, F.concat(F.lit(f"{name}="), F.array_join(name, ",")))
    notes = [listed("supersedes"), listed("invalidates")]
    if with_validity:
        notes.append(F.concat(F.lit("validity="), F.col("validity")))
    joined = F.concat_ws(" ; ", *notes)
    return F.when(joined == "", "").otherwise(F.concat(F.lit(" ["), joined, F.lit("]")))


def raw_rag(events: DataFrame, probes: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    line = F.concat("event_id", F.lit(": "), "content")
    return from_retrieval(R.topk_lexical(events, probes, k), events, "raw_rag", RAW, line)


def temporal_rag(events: DataFrame, probes: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    line = F.concat(iso_seconds(F.col("ts")), F.lit(" "), "event_id", F.lit(" "), "event_type", _annotated(True), F.lit(": "), "content")
    return from_retrieval(R.topk_temporal(events, probes, k), events, "temporal_raw_rag", TEMPORAL, line)


def submission_raw_rag(events: DataFrame, probes: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    line = F.concat("event_id", F.lit(": "), "event_type", F.lit(" "), "content")
    return from_retrieval(R.topk_submission_raw(events, probes, k), events, "raw_event_rag_input", RAW_INPUT, line)


def submission_temporal_rag(events: DataFrame, probes: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    line = F.concat("timestamp", F.lit(" "), "event_id", F.lit(" "), "event_type", _annotated(False), F.lit(": "), "content")
    return from_retrieval(R.topk_submission_temporal(events, probes, k), events, "temporal_event_rag_input", TEMPORAL_INPUT, line)


def oracle_graph(probes: DataFrame, memories: DataFrame, memory_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answer from the probe's own evidence memories, in evidence order."""
    ids = F.array_distinct(F.concat("evidence.positive", "evidence.negative", "evidence.obsolete"))
    wanted = probes.select("project_id", "probe_id", ids.alias("ids"))
    each = wanted.select("project_id", "probe_id", F.posexplode_outer("ids").alias("place", "memory_id"))

    def listed(label: str, field: str, human: bool) -> Column:
        items = F.col(f"action_boundary.{field}")
        shown = F.transform(items, humanize) if human else items
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(shown, ", ")))

    lines = F.concat_ws(
        "\n", F.concat(F.lit("Policy "), "memory_id", F.lit(": "), "content"), *[listed(*entry) for entry in BOUNDARY_LINES]
    )
    texts = (
        each.join(memories.withColumn("lines", lines).select("project_id", "memory_id", "lines"), ["project_id", "memory_id"])
        .groupBy("project_id", "probe_id")
        .agg(joined_list(F.col("place"), F.col("lines")).alias("parts"))
    )
    rows = wanted.join(texts, ["project_id", "probe_id"], "left")
    text = F.concat_ws("\n", F.lit(ORACLE), F.col("parts"))
    retrieved = (
        each.join(memory_events, ["project_id", "memory_id"]).select(
            F.lit("oracle_policy_graph").alias("baseline"), "project_id", "probe_id", "event_id", F.lit(None).cast("bigint").alias("rank")
        )
    ).dropDuplicates(["baseline", "project_id", "probe_id", "event_id"])
    return _prediction(rows, "oracle_policy_graph", text, F.col("ids")), retrieved


def policy_lines(query: Column, top_assignees: Column) -> Column:
    """Policy lines a question's wording calls for."""
    norm = normalize_text(query)
    none = F.array().cast("array<string>")
    negative = F.arrays_overlap(tokens(query), str_array(["negative", "blocked", "failed", "habit", "storage"]))
    merge = norm.contains("merge") | norm.contains("execution boundary") | norm.contains("boundary conditions")
    label, people = query_label(query), query_assignees(query)
    per_person = lambda names: F.flatten(
        F.transform(names, lambda a: F.array(F.concat(F.lit("assign "), a), F.concat(F.lit("request "), a, F.lit(" triage"))))
    )
    named = F.concat(
        F.when(label != "", F.array(F.concat(F.lit("apply "), label, F.lit(" label")))).otherwise(none), per_person(people)
    )
    allowed = F.when(F.size(named) > 0, named).otherwise(per_person(F.slice(F.coalesce(top_assignees, none), 1, 1)))
    triage = (label != "") | (F.size(people) > 0) | norm.contains("triage")
    allowed_line = F.when(
        F.size(allowed) > 0,
        F.array(F.concat(F.lit("Allowed actions: "), F.array_join(F.array_distinct(allowed), "; "), F.lit("."))),
    ).otherwise(none)
    return F.array_distinct(
        F.concat(
            F.when(negative, str_array(NEGATIVE_LINES)).otherwise(none),
            F.when(merge, str_array(MERGE_LINES)).otherwise(none),
            F.when(triage, F.concat(allowed_line, str_array(TRIAGE_LINES))).otherwise(none),
        )
    )


def event_profile_predictions(events: DataFrame, probes: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Retrieved events plus policy lines that the question's wording and the project's
    event profile suggest."""
    hits = R.topk_signal_boost(events, probes, k)
    profile = R.profile_row(R.event_profile(events)).select("project_id", "top_assignees")
    line = F.concat(F.lit("- "), "event_id", F.lit(": "), "event_type", F.lit(" "), "content")
    found = (
        hits.join(events, ["project_id", "event_id"])
        .groupBy("project_id", "probe_id")
        .agg(joined_list(F.col("rank"), line).alias("lines"))
    )
    rows = (
        probes.select("project_id", "probe_id", "query")
        .join(profile, "project_id", "left")
        .join(found, ["project_id", "probe_id"], "left")
        .withColumn("policy", policy_lines(F.col("query"), F.col("top_assignees")))
    )
    text = F.concat_ws(
        "\n",
        F.lit(PROFILE),
        F.concat(F.lit("Future task: "), "query"),
        F.when(F.size("policy") > 0, F.lit("Induced policy/action profile:")).otherwise(F.lit(PROFILE_FALLBACK)),
        F.col("policy"),
        F.when(F.size("lines") > 0, F.lit("Retrieved no-gold workflow events:")),
        F.col("lines"),
    )
    retrieved = hits.select(F.lit("event_profile").alias("baseline"), "project_id", "probe_id", "event_id", "rank")
    return _prediction(rows, "event_profile", text), retrieved


def run_predictors(
    names: list[str], events: DataFrame, probes: DataFrame, memories: DataFrame, memory_events: DataFrame, k: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Any subset of the release predictors over all projects, as one table each."""
    makers = {
        "no_memory": lambda: (no_memory(probes), None),
        "raw_rag": lambda: raw_rag(events, probes, k),
        "full_event_log": lambda: (full_log_answers(events, probes), None),
        "temporal_raw_rag": lambda: temporal_rag(events, probes, k),
        "oracle_policy_graph": lambda: oracle_graph(probes, memories, memory_events),
    }
    unknown = sorted(set(names) - set(makers))
    if unknown or not names:
        raise ValueError(f"unsupported predictors: {unknown or 'none requested'}; supported: {sorted(makers)}")
    tables = [makers[n]() for n in dict.fromkeys(names)]
    predictions = tables[0][0]
    for p, _ in tables[1:]:
        predictions = predictions.unionByName(p)
    found = [r for _, r in tables if r is not None]
    if not found:
        none = predictions.filter("false")
        return predictions, none.select("baseline", "project_id", "probe_id", F.lit("").alias("event_id"), F.lit(0).cast("bigint").alias("rank"))
    retrieved = found[0]
    for r in found[1:]:
        retrieved = retrieved.unionByName(r)
    return predictions, retrieved
