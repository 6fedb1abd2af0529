"""Annotation tasks with evidence, prompts, jobs, and the checks on returned proposals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.ids import exact_round, safe_id, split_of, stable_mean
from worktrail.functions.text import boundary_terms, no_strings, str_array
from worktrail.operators.ordering import group_positions, joined_list
from worktrail.schemas import BOUNDARY_FIELDS
from worktrail.session import pinned, scratch_path

# Instructions of a prompt; callers may pass their own.
SYSTEM_PROMPT = (
    "Work from the evidence below and nothing else. Restate the one candidate rule in clear words, then write one question about a later task that the rule decides. "
    "People, places, events, tools and permissions that neither the evidence nor the boundary names must not appear."
)
CLOSING = "Answer with a single JSON object in the given layout. Its question has to call for an act, a consent, a refusal, a request for details, or a choice of what to store."
CHECKLIST = [
    "Every statement of the rule can be found in an event shown.",
    "What may be done, and what may not, is as the events have it.",
    "The rule covers no more cases than the events do.",
    "The question asks for conduct in a later task, not for a remembered fact.",
]
NEGATIVE_CHECK = "What was refused once has not become a standing habit."


def annotation_tasks(candidates: DataFrame, profile: DataFrame) -> DataFrame:
    """One task per candidate of an eligible repository."""
    b = F.col("action_boundary")
    ready = candidates.join(profile.filter("eligible").select("repo"), "repo", "left_semi")
    checklist = F.when(
        F.col("candidate_type") == "negative_policy_example", str_array(CHECKLIST + [NEGATIVE_CHECK])
    ).otherwise(str_array(CHECKLIST))
    return ready.select(
        F.concat(F.lit("gharchive_policy_pack_"), safe_id(F.col("repo"))).alias("pack_id"),
        F.concat(F.lit("annot_"), "candidate_id").alias("annotation_id"),
        "*",
        boundary_terms(F.concat(b["allowed_actions"], b["requires_approval"], b["requires_clarification"])).alias("must_include_terms"),
        boundary_terms(b["forbidden_actions"]).alias("must_not_include_terms"),
        (F.col("candidate_type") == "negative_policy_example").alias("requires_negative_evidence"),
        checklist.alias("human_review_checklist"),
    )


def evidence_rows(tasks: DataFrame, events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Ordered evidence of each task, joined to event and artifact. Ids without an event
    keep their row with known = false."""
    entries = F.concat(
        F.transform("supporting_events", lambda e, i: F.struct(F.lit("supporting").alias("role"), i.alias("place"), e.alias("event_id"))),
        F.transform("negative_events", lambda e, i: F.struct(F.lit("negative").alias("role"), i.alias("place"), e.alias("event_id"))),
    )
    each = tasks.select("pack_id", "annotation_id", F.explode_outer(entries).alias("e")).select("pack_id", "annotation_id", "e.*")
    sources = events.select(
        "event_id", "source_dataset", "event_type", "timestamp", "actor", "content", "raw_pointer", "claims", "entities", "repo",
        F.get("artifacts", F.lit(0)).alias("artifact_id"), F.lit(True).alias("known"),
    )
    return (
        each.filter("event_id is not null")
        .join(sources, "event_id", "left")
        .join(artifacts.select("artifact_id", "uri", "content_hash"), "artifact_id", "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
    )


def task_issues(tasks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Issue rows (annotation_id, code) by five rules."""
    seen = evidence.groupBy("annotation_id").agg(
        F.count_if((F.col("role") == "supporting") & F.col("known")).alias("support"),
        F.count_if((F.col("role") == "negative") & F.col("known")).alias("negative"),
        F.count_if((F.col("role") == "supporting") & ~F.col("known")).alias("lost_support"),
        F.count_if((F.col("role") == "negative") & ~F.col("known")).alias("lost_negative"),
    )
    b = F.col("action_boundary")
    empty = (
        F.size(b["allowed_actions"]) + F.size(b["forbidden_actions"]) + F.size(b["requires_approval"]) + F.size(b["requires_clarification"])
    ) == 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    codes = F.array_compact(
        F.array(
            F.when(zero("support") == 0, "missing supporting evidence snippets"),
            F.when(zero("lost_support") > 0, "unknown supporting event ids"),
            F.when(zero("lost_negative") > 0, "unknown negative event ids"),
            F.when(F.col("requires_negative_evidence") & (zero("negative") == 0), "negative policy example lacks negative evidence"),
            F.when(empty, "action boundary is empty"),
        )
    )
    rows = tasks.join(seen, "annotation_id", "left").select("pack_id", "annotation_id", F.explode_outer(codes).alias("code"))
    return rows.filter("code is not null")


def packs(tasks: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per pack without issues, with its split, type counts and a content hash."""
    clean = tasks.join(issues.select("pack_id").distinct(), "pack_id", "left_anti")
    kinds = clean.groupBy("pack_id", "repo", "candidate_type").agg(F.count("*").alias("n"))
    named = kinds.groupBy("pack_id", "repo").agg(
        F.sum("n").alias("tasks"),
        F.array_join(F.array_sort(F.collect_list(F.concat("candidate_type", F.lit("="), F.col("n").cast("string")))), "|").alias("candidate_types"),
    )
    # Rule mining yields six tasks per repository at most.
    hashes = clean.groupBy("pack_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("annotation_id")), "\n"), 256).alias("content_hash")
    )
    return named.join(hashes, "pack_id").withColumn("split", split_of(F.col("repo")))


def release_tasks(tasks: DataFrame, pack_rows: DataFrame) -> DataFrame:
    return tasks.join(pack_rows.select("pack_id", "split"), "pack_id")


def scale_summary(pack_rows: DataFrame) -> DataFrame:
    return pack_rows.agg(
        F.count("*").alias("eligible_packs"),
        F.coalesce(F.sum("tasks"), F.lit(0)).alias("tasks_total"),
        F.coalesce(F.min("tasks"), F.lit(0)).alias("min_per_pack"),
        F.coalesce(F.max("tasks"), F.lit(0)).alias("max_per_pack"),
        exact_round(F.coalesce(stable_mean("tasks"), F.lit(0.0)), 4).alias("mean_per_pack"),
    )


def boundary_json(c: Column) -> Column:
    return F.to_json(F.struct(*[c[f].alias(f) for f in sorted(BOUNDARY_FIELDS)]))


def prompt_rows(tasks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Prompt text and constraints per task. Text only: nothing is sent anywhere."""
    snippet = F.concat(
        F.lit("- "),
        F.to_json(
            F.struct(
                "actor", "content", F.array_compact(F.array("content_hash")).alias("content_hashes"), "event_id", "event_type", "raw_pointer", "timestamp"
            )
        ),
    )
    known = evidence.filter("known").withColumn("line", snippet)
    lines = known.groupBy("annotation_id").agg(
        joined_list(F.col("place"), F.col("line"), F.col("role") == "supporting").alias("support_lines"),
        joined_list(F.col("place"), F.col("line"), F.col("role") == "negative").alias("negative_lines"),
    )
    b = F.col("action_boundary")
    expectations = F.to_json(
        F.struct(
            "must_include_terms",
            "must_not_include_terms",
            F.struct(*[b[f].alias(f) for f in sorted(BOUNDARY_FIELDS)]).alias("must_preserve_action_boundary"),
            F.col("negative_events").alias("negative_event_ids_must_be_subset_of"),
            F.col("supporting_events").alias("positive_event_ids_must_be_subset_of"),
            "requires_negative_evidence",
        )
    )
    none = no_strings()
    rows = tasks.join(lines, "annotation_id", "left")
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("Pack: "), "pack_id"),
        F.concat(F.lit("Annotation: "), "annotation_id"),
        F.concat(F.lit("Repository: "), "repo"),
        F.concat(F.lit("Candidate type: "), "candidate_type"),
        F.concat(F.lit("Policy candidate: "), "policy"),
        F.concat(F.lit("Mining rule: "), "mining_rule"),
        F.lit("Supporting evidence:"),
        F.coalesce("support_lines", none),
        F.lit("Negative evidence:"),
        F.when(F.size(F.coalesce("negative_lines", none)) > 0, F.col("negative_lines")).otherwise(F.array(F.lit("- none supplied"))),
        F.lit("Action boundary to preserve exactly or narrow, never widen:"),
        boundary_json(b),
        F.lit("Verifier expectations:"),
        expectations,
        F.lit(CLOSING),
    )
    return rows.select(
        F.concat(F.lit("prompt_"), "annotation_id").alias("prompt_id"),
        "pack_id",
        "annotation_id",
        "candidate_id",
        "candidate_type",
        "repo",
        F.lit("v1").alias("prompt_version"),
        F.lit(SYSTEM_PROMPT).alias("system_prompt"),
        prompt.alias("user_prompt"),
        F.col("supporting_events").alias("allowed_positive_event_ids"),
        F.col("negative_events").alias("allowed_negative_event_ids"),
        F.col("action_boundary"),
    )


def estimated_tokens(prompts: DataFrame) -> Column:
    text = F.concat_ws("\n", "system_prompt", "user_prompt", boundary_json(F.col("action_boundary")))
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("bigint")


def _next_starts(tokens: np.ndarray, max_prompts: int, max_tokens: int) -> np.ndarray:
    """For each prompt, the place after the bin that opens at it."""
    at = np.arange(len(tokens))
    total = np.concatenate([[0], np.cumsum(tokens)])
    full = np.searchsorted(total, total[:-1] + max_tokens, side="right") - 1
    return np.maximum(at + 1, np.minimum(at + max_prompts, full))


def pack_jobs(prompts: DataFrame, max_prompts: int = 100, max_tokens: int = 120000, shard_prompts: int = 100_000) -> DataFrame:
    """Bins of prompts in order, closed at a prompt or token limit: the bins of one running sum
    over all prompts, found in parallel.

    Each prompt points to the one that opens the next bin, at most ``max_prompts`` further. A
    shard of the ordered prompts therefore maps the few places where a bin may enter it to the
    places where bins enter the next shard, and to the number of bins between. These maps are
    chained by doubling over the shards, then every shard numbers its own bins. ``shard_prompts``
    bounds what a task holds and changes no bin.
    """
    size = max(shard_prompts, max_prompts)
    sized = prompts.select("prompt_id", "pack_id", "repo", estimated_tokens(prompts).alias("tokens"), F.lit(0).alias("all"))
    placed = group_positions(sized, ["all"], ["pack_id", "prompt_id"]).select("prompt_id", "pack_id", "repo", "tokens", "pos")
    placed = pinned(placed.withColumn("shard", F.expr(f"pos div {size}")))
    # A shard also sees the prompts behind it that its last bin may hold.
    seen = F.when((F.col("pos") % size < max_prompts) & (F.col("shard") > 0), F.array("shard", F.col("shard") - 1)).otherwise(F.array("shard"))
    wide = placed.select("pos", "tokens", F.explode(seen).alias("shard"))

    def crossed(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        steps = _next_starts(table.column("tokens").to_numpy(), max_prompts, max_tokens).tolist()
        n = min(size, len(steps))
        leave, bins = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            to = steps[i]
            leave[i], bins[i] = (to - size, 1) if to >= n else (leave[to], bins[to] + 1)
        enter = max_prompts if n == size else n
        return pa.table({"shard": table.column("shard").slice(0, 1), "leave": pa.array([leave[:enter]], pa.list_(pa.int64())), "bins": pa.array([bins[:enter]], pa.list_(pa.int64()))})

    maps = pinned(wide.groupBy("shard").applyInArrow(crossed, "shard long, leave array<long>, bins array<long>"))
    shards = (maps.agg(F.max("shard")).first()[0] or 0) + 1
    reach = 1
    while reach < shards:
        back = maps.select((F.col("shard") + reach).alias("shard"), F.col("leave").alias("by"), F.col("bins").alias("before"))
        both = maps.join(back, "shard", "left")
        chained = lambda of: F.transform("by", lambda x: F.get(of, x.cast("int")))
        counted = F.transform("before", lambda x, i: x + F.get("bins", F.get("by", i).cast("int")))
        maps = pinned(both.select("shard", F.coalesce(chained("leave"), "leave").alias("leave"), F.coalesce(counted, "bins").alias("bins")))
        reach *= 2
    entries = maps.select((F.col("shard") + 1).alias("shard"), F.get("leave", F.lit(0)).alias("enter"), F.get("bins", F.lit(0)).alias("opened"))
    columns = "prompt_id string, pack_id string, repo string, tokens long, job_id string"

    def numbered(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        steps = _next_starts(table.column("tokens").to_numpy(), max_prompts, max_tokens).tolist()
        opens = np.zeros(len(steps), dtype=np.int64)
        at = table.column("enter")[0].as_py()
        while at < len(steps):
            opens[at] = 1
            at = steps[at]
        jobs = np.cumsum(opens) + table.column("opened")[0].as_py()
        return table.select(["prompt_id", "pack_id", "repo", "tokens"]).append_column("job_id", pa.array([f"rewrite_job_{j:04d}" for j in jobs.tolist()]))

    zero = F.lit(0).cast("long")
    own = placed.join(entries, "shard", "left").withColumns({"enter": F.coalesce("enter", zero), "opened": F.coalesce("opened", zero)})
    return own.groupBy("shard").applyInArrow(numbered, columns)


def job_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_id").agg(
        F.count("*").alias("prompts"), F.sum("tokens").alias("estimated_tokens"), F.count_distinct("pack_id").alias("packs")
    )


def proposal_template(prompts: DataFrame) -> DataFrame:
    return prompts.select(
        F.lit("").alias("proposal_id"), "pack_id", "annotation_id", "candidate_id", F.lit("").alias("rewritten_policy"),
        F.lit("").alias("future_probe_query"), no_strings().alias("must_include"), no_strings().alias("must_not_include"),
        F.col("allowed_positive_event_ids").alias("positive_event_ids"), F.col("allowed_negative_event_ids").alias("negative_event_ids"),
        "action_boundary",
    )


# Returned proposals ------------------------------------------------------------------------


def completion_issues() -> Column:
    """Names of the fields of a proposal that are empty."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    lists = lambda c: F.size(F.coalesce(c, no_strings()))
    b = F.col("action_boundary")
    return F.array_compact(
        F.array(
            *[F.when(blank(f), F.lit(f)) for f in ("proposal_id", "annotation_id", "candidate_id", "rewritten_policy", "future_probe_query")],
            F.when(lists("must_include") == 0, F.lit("expected_behavior.must_include")),
            F.when(lists("must_not_include") == 0, F.lit("expected_behavior.must_not_include")),
            F.when(lists("positive_event_ids") == 0, F.lit("positive_event_ids")),
            F.when(
                lists(b["allowed_actions"]) + lists(b["forbidden_actions"]) + lists(b["requires_approval"]) + lists(b["requires_clarification"]) == 0,
                F.lit("action_boundary"),
            ),
        )
    )


def collect_outputs(rows: DataFrame) -> DataFrame:
    """Decide every returned row in row order: unfilled rows are withheld; of the others a
    row is taken unless an earlier taken row has its proposal id or its annotation.

    In each round every row that is first among the undecided for both keys is taken, and
    the rows it blocks are dropped, which is the row-by-row result without one task that
    reads all rows. Each round decides a row at least, and rounds go on until none is open;
    their number grows with chains of clashing rows only. A round is one table, written once:
    its decided rows, and the open ones that the next round starts from.
    """
    checked = rows.withColumn("missing", completion_issues())
    unfilled = checked.filter(F.size("missing") > 0).select("row_no", F.lit("unfilled_proposal").alias("state"))
    keys = ["row_no", "proposal_id", "pack_id", "annotation_id"]
    spark = rows.sparkSession
    path = scratch_path(spark, "decided")
    named = checked.withColumn("pack_id", F.coalesce("pack_id", F.lit("")))
    open_rows = named.filter(F.size("missing") == 0).select(*keys)
    number = 0
    while True:
        by_id = open_rows.groupBy("proposal_id").agg(F.min("row_no").alias("first_id"))
        by_key = open_rows.groupBy("pack_id", "annotation_id").agg(F.min("row_no").alias("first_key"))
        placed = open_rows.join(by_id, "proposal_id").join(by_key, ["pack_id", "annotation_id"])
        taken = placed.filter("row_no = first_id AND row_no = first_key")
        ids = taken.select("proposal_id", F.lit(True).alias("id_taken"))
        pairs = taken.select("pack_id", "annotation_id", F.lit(True).alias("key_taken"))
        state = F.when((F.col("row_no") == F.col("first_id")) & (F.col("row_no") == F.col("first_key")), "collected")
        state = state.when(F.col("id_taken"), "duplicate_proposal_id").when(F.col("key_taken"), "duplicate_annotation_output")
        marked = placed.join(ids, "proposal_id", "left").join(pairs, ["pack_id", "annotation_id"], "left").select(*keys, state.alias("state"))
        marked.write.parquet(f"{path}/round={number}")
        done = spark.read.schema(marked.schema).parquet(f"{path}/round={number}")
        open_rows = done.filter("state IS NULL").select(*keys)
        if open_rows.isEmpty():
            break
        number += 1
    decided = spark.read.schema(done.schema).option("basePath", path).parquet(path).filter("state IS NOT NULL").select("row_no", "state")
    return rows.join(unfilled.unionByName(decided), "row_no")


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def boundary_subset(proposed: Column, allowed: Column) -> dict[str, Column]:
    """Seven subset tests; allowed actions must also be present."""
    fields = [
        "allowed_actions", "forbidden_actions", "conditions", "requires_approval", "requires_clarification", "authorized_tools", "forbidden_tools",
    ]
    checks = {f"{f}_subset": subset(proposed[f], allowed[f]) for f in fields}
    checks["allowed_actions_subset"] = checks["allowed_actions_subset"] & (F.size(proposed["allowed_actions"]) > 0)
    return checks


def validate_proposals(proposals: DataFrame, tasks: DataFrame) -> DataFrame:
    """Named checks, issues and warnings per proposal."""
    known = tasks.select(
        "annotation_id",
        F.col("candidate_id").alias("task_candidate_id"),
        "candidate_type",
        F.col("supporting_events").alias("allowed_positive"),
        F.col("negative_events").alias("allowed_negative"),
        F.col("action_boundary").alias("task_boundary"),
        "must_include_terms",
        "must_not_include_terms",
        "requires_negative_evidence",
    )
    rows = proposals.join(known, "annotation_id", "left").withColumn("known", F.col("task_candidate_id").isNotNull())
    text = F.lower(F.translate(F.concat_ws(" ", "rewritten_policy", "future_probe_query", "must_include", "must_not_include"), "_", " "))
    rows = rows.withColumn("expected_text", text)
    has_any = lambda terms: F.exists(terms, lambda t: F.col("expected_text").contains(F.lower(t)))
    negative = F.col("requires_negative_evidence")
    full = F.concat_ws(" ", F.lower(F.translate(F.concat_ws(" ", "rewritten_policy", "future_probe_query"), "_", " ")), "expected_text")
    kept = full.contains("default") & (full.contains("habit") | full.contains("assistant"))
    checks: dict[str, Column] = {
        "candidate_id_matches": F.col("candidate_id") == F.col("task_candidate_id"),
        "positive_event_ids_grounded": subset(F.col("positive_event_ids"), F.col("allowed_positive")) & (F.size("positive_event_ids") > 0),
        "negative_event_ids_grounded": subset(F.col("negative_event_ids"), F.col("allowed_negative")),
        "negative_requirement_preserved": ~negative | (F.size("negative_event_ids") > 0),
        **boundary_subset(F.col("action_boundary"), F.col("task_boundary")),
        "expected_behavior_covers_allowed_or_required_terms": has_any("must_include_terms"),
        "negative_example_not_converted_to_default_habit": ~negative | kept,
    }
    failed = F.array_compact(F.array(*[F.when(~passed, F.lit(name)) for name, passed in checks.items()]))
    out = rows.withColumn("failed_checks", F.when(F.col("known"), failed).otherwise(F.array(F.lit("known_annotation"))))
    weak = F.col("known") & ~has_any("must_not_include_terms")
    return out.withColumn(
        "warnings", F.when(weak, F.array(F.lit("expected_behavior_mentions_forbidden_terms"))).otherwise(no_strings())
    ).withColumn("passed", F.size("failed_checks") == 0).drop(
        "allowed_positive", "allowed_negative", "task_boundary", "must_include_terms", "must_not_include_terms", "expected_text", "task_candidate_id"
    )


def match_packs(proposals: DataFrame, tasks: DataFrame) -> DataFrame:
    """(pack_id, row_no) where annotation, candidate or pack agrees. Four equi-joins and a
    distinct instead of one OR condition, which would compare all pairs."""
    known = tasks.select(F.col("pack_id").alias("pack"), "annotation_id", "candidate_id")
    all_packs = tasks.select(F.col("pack_id").alias("pack")).distinct()
    parts = [
        proposals.select("row_no", "annotation_id").join(known.select("pack", "annotation_id").distinct(), "annotation_id"),
        proposals.select("row_no", "candidate_id").join(known.select("pack", "candidate_id").distinct(), "candidate_id"),
        proposals.select("row_no", F.col("pack_id").alias("pack")).join(all_packs, "pack"),
        proposals.select("row_no", F.col("metadata")["pack_id"].alias("pack")).join(all_packs, "pack"),
    ]
    out = parts[0].select("pack", "row_no")
    for p in parts[1:]:
        out = out.unionByName(p.select("pack", "row_no"))
    return out.distinct()


def pack_validation(validated: DataFrame, tasks: DataFrame, matches: DataFrame) -> DataFrame:
    """Per pack: proposals, failures and tasks without a proposal."""
    totals = tasks.groupBy("pack_id").agg(F.count("*").alias("annotation_tasks"))
    rows = matches.withColumnRenamed("pack", "pack_id").join(
        validated.select("row_no", "annotation_id", "passed"), "row_no"
    )
    own = rows.join(tasks.select("pack_id", "annotation_id", F.lit(True).alias("own")), ["pack_id", "annotation_id"], "left")
    counted = own.groupBy("pack_id").agg(
        F.count("*").alias("proposals_total"),
        F.count_if(F.col("passed") & F.coalesce("own", F.lit(False))).alias("proposals_passed"),
        F.count_distinct(F.when(F.col("own"), F.col("annotation_id"))).alias("covered"),
    )
    zero = F.lit(0)
    return (
        totals.join(counted, "pack_id", "left")
        .select(
            "pack_id",
            "annotation_tasks",
            F.coalesce("proposals_total", zero).alias("proposals_total"),
            F.coalesce("proposals_passed", zero).alias("proposals_passed"),
            (F.coalesce("proposals_total", zero) - F.coalesce("proposals_passed", zero)).alias("proposals_failed"),
            (F.col("annotation_tasks") - F.coalesce("covered", zero)).alias("missing_annotation_outputs"),
        )
        .withColumn("passed", (F.col("proposals_failed") == 0) & (F.col("missing_annotation_outputs") == 0))
    )


def merge_by_prompt_order(prompts: DataFrame, rows: DataFrame) -> DataFrame:
    """Later row wins per annotation; rows of unknown annotations come last."""
    last = rows.filter("annotation_id <> ''").groupBy("annotation_id").agg(
        F.max_by(F.struct(*rows.columns), F.col("row_no")).alias("r"), F.min("row_no").alias("first_row")
    )
    return last.select("annotation_id", "first_row", F.struct([F.col(f"r.{c}").alias(c) for c in rows.columns if c != "annotation_id"]).alias("r")).select(
        "annotation_id", "first_row", "r.*"
    ).join(prompts.select("annotation_id", "prompt_no"), "annotation_id", "left")


def normalize_output(outputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Model text to a proposal: fence and prose are cut off, ids come from the prompt,
    empty fields get the prompt's values, and each such change is named."""
    schema = (
        "struct<proposal_id:string,annotation_id:string,candidate_id:string,rewritten_policy:string,future_probe_query:string,"
        "expected_behavior:struct<must_include:array<string>,must_not_include:array<string>>,positive_event_ids:array<string>,"
        "negative_event_ids:array<string>>"
    )
    body = F.regexp_replace(F.trim("text"), r"^```(?:json)?\s*|\s*```$", "")
    start = F.instr(body, "{")
    obj = F.when(start > 0, F.from_json(F.expr("substring(body, instr(body, '{'))"), schema))
    rows = outputs.withColumn("body", body).withColumn("obj", obj).join(
        prompts.select(
            "prompt_id", F.col("annotation_id").alias("p_annotation"), F.col("candidate_id").alias("p_candidate"),
            F.col("allowed_positive_event_ids").alias("p_positive"), F.col("allowed_negative_event_ids").alias("p_negative"),
        ),
        "prompt_id",
    )
    o = F.col("obj")
    ok = o.isNotNull() & F.coalesce(
        o["annotation_id"], o["candidate_id"], o["proposal_id"], o["rewritten_policy"], o["future_probe_query"]
    ).isNotNull()
    differs = lambda field, want: ~F.col("obj")[field].eqNullSafe(F.col(want))
    no_id = F.coalesce(o["proposal_id"], F.lit("")) == ""
    no_positive = F.size(F.coalesce(o["positive_event_ids"], no_strings())) == 0
    coercions = F.array_compact(
        F.array(
            F.when(differs("annotation_id", "p_annotation"), "annotation_id"),
            F.when(differs("candidate_id", "p_candidate"), "candidate_id"),
            F.when(no_id, "proposal_id"),
            F.when(no_positive, "positive_event_ids"),
            F.when(o["negative_event_ids"].isNull(), "negative_event_ids"),
            F.when(o["expected_behavior"].isNull(), "expected_behavior"),
        )
    )
    return rows.select(
        "prompt_id",
        ok.alias("parsed"),
        F.when(ok, F.col("p_annotation")).alias("annotation_id"),
        F.when(ok, F.col("p_candidate")).alias("candidate_id"),
        F.when(ok, F.when(no_id, F.concat(F.lit("proposal_"), safe_id(F.col("p_candidate")))).otherwise(o["proposal_id"])).alias("proposal_id"),
        F.when(ok, o["rewritten_policy"]).alias("rewritten_policy"),
        F.when(ok, F.when(no_positive, F.col("p_positive")).otherwise(o["positive_event_ids"])).alias("positive_event_ids"),
        F.when(ok, F.coalesce(o["negative_event_ids"], F.col("p_negative"))).alias("negative_event_ids"),
        F.when(ok, coercions).otherwise(no_strings()).alias("coercions"),
    )


