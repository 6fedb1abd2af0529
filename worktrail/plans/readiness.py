"""Threshold checks over measured values: stage plan, release scale, gate roll-ups.

Every measure is one row (name, actual); thresholds are a short fixed table; a check is
their equi-join. Nothing is collected to decide a status.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.ids import exact_round
from worktrail.operators.ordering import beside

# Thresholds of the three profiles.
PROFILES = {
    "fixture": {
        "packs": 1, "repos": 1, "tasks": 1, "nonempty_splits": 1, "train_tasks": 1, "dev_tasks": 0, "test_tasks": 0, "candidate_types": 1,
        "required_types": [], "events": 1, "eligible_windows": 0, "multi_window_repos": 0, "span_days": 0, "long_repos": 0,
        "max_empty_splits": 2, "max_skipped_ratio": 1.0,
    },
    "pilot": {
        "packs": 5, "repos": 5, "tasks": 20, "nonempty_splits": 2, "train_tasks": 5, "dev_tasks": 1, "test_tasks": 1, "candidate_types": 2,
        "required_types": ["authorization_boundary", "negative_policy_example"], "events": 100, "eligible_windows": 3, "multi_window_repos": 2,
        "span_days": 7, "long_repos": 2, "max_empty_splits": 0, "max_skipped_ratio": 0.8,
    },
    "paper": {
        "packs": 30, "repos": 30, "tasks": 150, "nonempty_splits": 3, "train_tasks": 60, "dev_tasks": 20, "test_tasks": 20, "candidate_types": 3,
        "required_types": ["authorization_boundary", "contextual_policy", "issue_triage_policy", "negative_policy_example"],
        "events": 1000, "eligible_windows": 30, "multi_window_repos": 15, "span_days": 14, "long_repos": 15, "max_empty_splits": 0,
        "max_skipped_ratio": 0.7,
    },
}


def thresholds(profile: str, overrides: dict | None = None) -> dict:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; choose from {sorted(PROFILES)}")
    return {**PROFILES[profile], **{k: v for k, v in (overrides or {}).items() if v is not None}}


def measures(df: DataFrame, **columns: Column | str) -> DataFrame:
    """One-row table to (name, actual) rows."""
    entries = [F.struct(F.lit(n).alias("name"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("actual")) for n, c in columns.items()]
    return df.select(F.explode(F.array(*entries)).alias("m")).select("m.*")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_minimums(measured: DataFrame, required: dict[str, float], maximum: tuple[str, ...] = ()) -> DataFrame:
    """Rows (check, status, actual, required, missing); names in ``maximum`` are ceilings."""
    spark = measured.sparkSession
    table = spark.createDataFrame([(k, float(v), k in maximum) for k, v in required.items()], "name string, required double, ceiling boolean")
    joined = measured.join(F.broadcast(table), "name")
    ok = F.when(F.col("ceiling"), F.col("actual") <= F.col("required")).otherwise(F.col("actual") >= F.col("required"))
    return joined.select(
        F.col("name").alias("check"),
        F.when(ok, "pass").otherwise("fail").alias("status"),
        "actual",
        "required",
        F.when(F.col("ceiling"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("required") - F.col("actual"))).alias("missing"),
    )


def type_coverage(type_counts: DataFrame, required_types: list[str]) -> DataFrame:
    """Distinct candidate types, and how many required ones are absent, as measures."""
    seen = type_counts.groupBy("candidate_type").agg(F.sum("candidates").alias("n"))
    hit = F.count_if(F.col("candidate_type").isin(required_types)) if required_types else F.lit(0)
    return measures(
        seen.agg(F.count("*").alias("kinds"), hit.alias("hit")),
        candidate_types="kinds",
        missing_required_types=F.lit(len(required_types)) - F.col("hit"),
    )


def stage_plan(quality: DataFrame, windows: DataFrame, spans: DataFrame, type_counts: DataFrame, profile: str = "paper") -> DataFrame:
    """Seven checks on a raw slice before any annotation work."""
    limits = thresholds(profile)
    measured = union(
        [
            measures(quality, events="events_total", eligible_repos="repos_eligible"),
            measures(windows, eligible_windows="eligible_windows", multi_window_repos="repos_spanning_multiple_windows"),
            measures(spans.agg(F.count_if(F.col("span_days") >= limits["span_days"]).alias("n")), longitudinal_span="n"),
            measures(type_counts.agg(F.coalesce(F.sum("candidates"), F.lit(0)).alias("n")), candidate_count="n"),
        ]
    )
    rows = check_minimums(
        measured,
        {
            "events": limits["events"], "eligible_repos": limits["repos"], "candidate_count": limits["tasks"],
            "eligible_windows": limits["eligible_windows"], "multi_window_repos": limits["multi_window_repos"], "longitudinal_span": limits["long_repos"],
        },
    )
    kinds = type_coverage(type_counts, limits["required_types"]).groupBy().pivot("name", ["candidate_types", "missing_required_types"]).agg(F.first("actual"))
    ok = (F.col("candidate_types") >= limits["candidate_types"]) & (F.col("missing_required_types") == 0)
    typed = kinds.select(
        F.lit("candidate_types").alias("check"),
        F.when(ok, "pass").otherwise("fail").alias("status"),
        F.col("candidate_types").alias("actual"),
        F.lit(float(limits["candidate_types"])).alias("required"),
        F.greatest(F.lit(0.0), F.lit(float(limits["candidate_types"])) - F.col("candidate_types")).alias("missing"),
    )
    return rows.unionByName(typed)


def decision(checks: DataFrame, profile: str) -> DataFrame:
    """One row: whether annotation may start and which checks block it."""
    failed = checks.agg(F.array_sort(F.collect_list(F.when(F.col("status") == "fail", F.col("check")))).alias("blocking"))
    mode = {"paper": "paper_scale_annotation", "pilot": "pilot_annotation"}.get(profile)
    passed = F.size("blocking") == 0
    return failed.select(
        (passed & F.lit(mode is not None)).alias("ready_for_annotation_budget"),
        (F.when(passed, mode).otherwise("expand_or_restage_slice") if mode else F.lit("engineering_fixture")).alias("recommended_mode"),
        F.array_join("blocking", "|").alias("blocking_checks"),
    )


def release_stats(packs: DataFrame, tasks: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row about a release: sizes, splits, types and the share of skipped repositories."""
    by_split = tasks.groupBy("split").agg(F.count("*").alias("n"))
    splits = by_split.agg(
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"{s}_tasks") for s in ("train", "dev", "test")],
        F.count("*").alias("nonempty_splits"),
        F.coalesce(F.max("n") / F.min("n"), F.lit(0.0)).alias("imbalance"),
    )
    kinds = tasks.groupBy("candidate_type").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("candidate_types"), F.coalesce(F.max("n"), F.lit(0)).alias("dominant"), F.coalesce(F.sum("n"), F.lit(0)).alias("tasks")
    )
    head = packs.agg(F.count("*").alias("packs"), F.count_distinct("repo").alias("repos"))
    lost = skipped.agg(F.count("*").alias("skipped_repos"))
    out = beside(head, lost, splits, kinds)
    both = F.col("skipped_repos") + F.col("packs")
    return (
        out.withColumn("empty_splits", F.lit(3) - F.col("nonempty_splits"))
        .withColumn("skipped_ratio", exact_round(F.when(both > 0, F.col("skipped_repos") / both).otherwise(F.lit(0.0)), 4))
        .withColumn("dominant_share", exact_round(F.when(F.col("tasks") > 0, F.col("dominant") / F.col("tasks")).otherwise(F.lit(0.0)), 4))
        .withColumn("imbalance", exact_round(F.col("imbalance"), 4))
        .drop("dominant")
    )


def assess_scale(stats: DataFrame, type_counts: DataFrame, quality: DataFrame, windows: DataFrame, spans: DataFrame, profile: str = "paper", overrides: dict | None = None) -> DataFrame:
    """All release checks of a profile, then two warnings about balance."""
    limits = thresholds(profile, overrides)
    names = ["packs", "repos", "tasks", "nonempty_splits", "train_tasks", "dev_tasks", "test_tasks"]
    measured = union(
        [
            measures(stats, **{n: n for n in names}, empty_splits="empty_splits", skipped_ratio="skipped_ratio"),
            type_coverage(type_counts, limits["required_types"]),
            measures(quality, events="events_total", eligible_repos="repos_eligible"),
            measures(windows, eligible_windows="eligible_windows", multi_window_repos="repos_spanning_multiple_windows"),
            measures(spans.agg(F.count_if(F.col("span_days") >= limits["span_days"]).alias("n")), long_repos="n"),
        ]
    )
    required = {n: limits[n] for n in names} | {
        "candidate_types": limits["candidate_types"], "missing_required_types": 0, "empty_splits": limits["max_empty_splits"],
        "skipped_ratio": limits["max_skipped_ratio"], "events": limits["events"], "eligible_repos": limits["repos"],
        "eligible_windows": limits["eligible_windows"], "multi_window_repos": limits["multi_window_repos"], "long_repos": limits["long_repos"],
    }
    rows = check_minimums(measured, required, ("missing_required_types", "empty_splits", "skipped_ratio"))
    balance = measures(stats, split_imbalance="imbalance", dominant_type_share="dominant_share")
    limit = F.when(F.col("name") == "split_imbalance", 10.0).otherwise(0.75)
    warned = balance.select(
        F.col("name").alias("check"),
        F.when(F.col("actual") > limit, "warn").otherwise("pass").alias("status"),
        "actual",
        limit.alias("required"),
        F.lit(0.0).alias("missing"),
    )
    return rows.unionByName(warned)


def gate_rollup(checks: DataFrame) -> DataFrame:
    """Checks of many families to one row: counts by status, blocking list, verdict. The
    list holds check names, of which there are few."""
    return checks.agg(
        F.count("*").alias("checks_total"),
        F.count_if(F.col("status") == "pass").alias("passed_checks"),
        F.count_if(F.col("status") == "warn").alias("warnings"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "fail", F.concat_ws("/", "family", "check")))), "|").alias("blocking"),
    ).withColumn("passed", F.col("failed") == 0)


# Workflow domains, the tokens that show them, and their state when absent.
DOMAINS = [
    ("github_developer_workflow", "GitHub developer workflow", ["gharchive", "github"], "planned_not_released"),
    ("email_workflow", "Email workflow", ["email", "enron", "avocado"], "blocked_license_privacy_manifest"),
    ("calendar_workflow", "Calendar workflow", ["calendar"], "planned_not_released"),
    ("docs_workflow", "Document workflow", ["docs", "document"], "planned_not_released"),
    ("chat_workflow", "Chat workflow", ["chat", "slack", "teams"], "planned_not_released"),
    ("browser_web_workflow", "Browser/web-search workflow", ["browser", "web", "search", "web_search", "workarena", "mind2web"], "planned_not_released"),
]
GATES = [
    "reusable_trace_source", "license_privacy_pii_gate", "canonical_event_adapter", "verifier_checked_project_release", "no_gold_submission_input",
    "baseline_and_external_runner_contract", "taxonomy_and_claim_boundary", "readiness_and_artifact_gate",
]
# Release checks that each of the later gates needs.
GATE_NEEDS = {
    "verifier_checked_project_release": ["project_release"],
    "no_gold_submission_input": ["project_submission_inputs"],
    "baseline_and_external_runner_contract": ["project_release_baselines", "baseline_batch"],
    "taxonomy_and_claim_boundary": ["taxonomy_coverage_audit", "claim_boundary_audit"],
    "readiness_and_artifact_gate": ["artifact_bundle_manifest"],
}
TASK_FAMILIES = {
    "contextual_workflow_policy_selection": "contextual_policy_selection",
    "tool_action_policy_alignment": "tool_action_alignment",
    "negative_example_storage_gating": "negative_example_storage_gating",
    "privacy_authorization_boundary": "privacy_authorization_boundary",
    "policy_update_and_exception_handling": "policy_update_exception_handling",
    "routine_completion": "proactive_routine_recognition",
}


def domain_coverage(names: DataFrame) -> DataFrame:
    """``names`` holds (kind, name, n): dataset or stream names with their counts. A domain
    is covered when one of its tokens is part of a name."""
    spark = names.sparkSession
    table = spark.createDataFrame([(d, t, s) for d, _, ts, s in DOMAINS for t in ts], "domain string, token string, absent string")
    # Names are distinct dataset and stream names, a short list after the count.
    tokens = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(t).alias("token")) for d, _, ts, _ in DOMAINS for t in ts])
    hits = names.select("kind", "name", "n", F.explode(tokens).alias("t")).filter(F.contains(F.lower("name"), F.col("t.token")))
    seen = hits.select("kind", "name", "n", "t.domain").distinct().groupBy("domain").agg(
        F.sum(F.when(F.col("kind") == "dataset", F.col("n")).otherwise(0)).alias("evidence_count"),
        F.array_join(F.array_sort(F.collect_set("name")), "|").alias("matched"),
    )
    domains = table.select("domain", "absent").distinct()
    return domains.join(seen, "domain", "left").select(
        "domain",
        F.when(F.col("matched").isNotNull(), "covered").otherwise(F.col("absent")).alias("status"),
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.coalesce("matched", F.lit("")).alias("matched"),
    )


def taxonomy_counts(probes: DataFrame, events: DataFrame, artifacts: DataFrame, memories: DataFrame, splits: DataFrame) -> DataFrame:
    """One long table (dimension, value, n) of everything a release covers."""
    families = F.create_map(*[F.lit(x) for pair in TASK_FAMILIES.items() for x in pair])
    family = F.coalesce(F.try_element_at(families, F.col("task_type")), F.col("task_type"))
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    of = lambda d, c: F.transform(c, lambda v: pair(d, v))
    rows = [
        probes.join(splits, "project_id").select(
            F.explode(
                F.concat(
                    F.array(pair("task_type", F.col("task_type")), pair("task_family", family), pair("split", F.col("split")), pair("difficulty", F.col("difficulty"))),
                    of("capability", F.col("capabilities")),
                    of("metric", F.col("metrics")),
                )
            ).alias("d")
        ),
        events.select(
            F.explode(
                F.array(
                    pair("event_source_dataset", F.col("source_dataset")), pair("event_type", F.col("event_type")),
                    pair("raw_event_type", F.col("metadata")["github_event_type"]),
                )
            ).alias("d")
        ),
        artifacts.select(F.explode(F.array(pair("artifact_source_dataset", F.col("source_dataset")), pair("artifact_type", F.col("artifact_type")))).alias("d")),
        memories.select(F.explode(F.array(pair("memory_type", F.col("memory_type")))).alias("d")),
    ]
    return union([r.select("d.*").filter("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n")) for r in rows])


def release_checks(
    verdicts: DataFrame, input_issues: DataFrame, scored: DataFrame, probes: DataFrame, baselines: list[str], submission_issues: DataFrame,
    submission_coverage: DataFrame, coverage: DataFrame, claims: DataFrame, drift: DataFrame,
) -> DataFrame:
    """(check, passed): the release checks that the domain gates need, read off the tables of a
    release.

    verdicts (project_id, passed); input_issues (code, n) of the public inputs; scored (baseline,
    project_id, probe_id, known); probes of the release; submission_issues (code, n) and
    submission_coverage (probe_coverage) of the submitted systems; coverage: domain_coverage();
    claims (allowed) lines of claims; drift: differences between the recorded and the present
    files of the bundle.
    """
    some = F.count("*") > 0
    asked = probes.agg(F.count("*").alias("asked"), F.count_distinct("task_type").alias("tasks"))
    told = scored.filter("known").groupBy("baseline").agg(F.count_distinct("project_id", "probe_id").alias("n"))
    named = beside(told.filter(F.col("baseline").isin(baselines)), asked).agg((F.count_if((F.col("n") == F.col("asked")) & (F.col("asked") > 0)) == len(set(baselines))).alias("passed"))
    batch = beside(submission_coverage.select("probe_coverage"), submission_issues.agg(F.count("*").alias("faults"))).agg((some & F.bool_and((F.col("probe_coverage") == 1) & (F.col("faults") == 0))).alias("passed"))
    covered = beside(coverage.agg(F.count_if(F.col("status") == "covered").alias("domains")), asked).select(((F.col("domains") > 0) & (F.col("tasks") > 0)).alias("passed"))
    rows = {
        "project_release": verdicts.agg((some & F.coalesce(F.bool_and("passed"), F.lit(False))).alias("passed")),
        "project_submission_inputs": input_issues.agg((F.count("*") == 0).alias("passed")),
        "project_release_baselines": named,
        "baseline_batch": batch,
        "taxonomy_coverage_audit": covered,
        "claim_boundary_audit": claims.agg((F.count_if(~F.col("allowed")) == 0).alias("passed")),
        "artifact_bundle_manifest": drift.agg((F.count("*") == 0).alias("passed")),
    }
    return union([df.select(F.lit(name).alias("check"), F.coalesce("passed", F.lit(False)).alias("passed")) for name, df in rows.items()])


def domain_gates(coverage: DataFrame, sources: DataFrame, release_checks: DataFrame, readiness_passed: DataFrame, preflights: DataFrame | None = None) -> DataFrame:
    """Domain by gate, with status. ``sources`` holds (domain, sources), ``release_checks``
    (check, passed), ``readiness_passed`` one row (passed). ``preflights`` (domain, passed): a
    manifest whose preflight passed is a source of its domain."""
    if preflights is not None:
        more = preflights.filter("passed").select("domain").distinct().withColumn("sources", F.lit(1).cast("long"))
        sources = sources.unionByName(more)
    sources = sources.groupBy("domain").agg(F.sum("sources").alias("sources"))
    needs = [(g, c) for g, cs in GATE_NEEDS.items() for c in cs]
    spark = coverage.sparkSession
    needed = spark.createDataFrame(needs, "gate string, check string")
    released = needed.join(release_checks, "check", "left").groupBy("gate").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("released"))
    cells = (
        coverage.select("domain", "status", F.explode(F.array(*[F.lit(g) for g in GATES])).alias("gate"))
        .join(sources, "domain", "left")
        .join(released, "gate", "left")
    )
    cells = beside(cells, readiness_passed.select(F.col("passed").alias("ready")))
    covered, sourced = F.col("status") == "covered", F.coalesce("sources", F.lit(0)) > 0
    passed = (
        F.when(F.col("gate") == "reusable_trace_source", sourced)
        .when(F.col("gate") == "license_privacy_pii_gate", sourced | (F.col("domain") == "github_developer_workflow"))
        .when(F.col("gate") == "canonical_event_adapter", F.lit(True))
        .when(F.col("gate") == "readiness_and_artifact_gate", covered & F.col("released") & F.col("ready"))
        .otherwise(covered & F.col("released"))
    )
    return cells.select("domain", F.col("status").alias("taxonomy_status"), "gate", passed.alias("passed"), F.coalesce("sources", F.lit(0)).alias("sources"))


def domain_matrix(gates: DataFrame) -> DataFrame:
    """One row per domain: a column per gate, blockers and the domain's status."""
    wide = gates.groupBy("domain", "taxonomy_status", "sources").pivot("gate", GATES).agg(F.bool_and("passed"))
    ready = F.forall(F.array(*[F.col(g) for g in GATES]), lambda g: g)
    blockers = F.array_join(F.array_compact(F.array(*[F.when(~F.col(g), F.lit(g)) for g in GATES])), "|")
    covered = F.col("taxonomy_status") == "covered"
    status = (
        F.when(ready, "current_release_ready")
        .when(covered, "covered_but_release_gate_incomplete")
        .when((F.col("domain") == "email_workflow") & (F.col("sources") <= 0), "blocked_license_privacy_manifest")
        .when((F.col("domain") != "github_developer_workflow") & (F.col("sources") > 0), "source_manifest_ready_release_pipeline_missing")
        .otherwise("planned_not_released")
    )
    return wide.withColumn("ready", ready).withColumn("blockers", blockers).withColumn("status", status)


# Source kinds and the domain each one feeds.
SOURCE_DOMAINS = {
    "gharchive_public_events": "github_developer_workflow",
    "email_workflow_manifest": "email_workflow",
    "calendar_workflow_manifest": "calendar_workflow",
    "docs_workflow_manifest": "docs_workflow",
    "chat_workflow_manifest": "chat_workflow",
    "browser_web_workflow_manifest": "browser_web_workflow",
}


def source_audit(sources: DataFrame) -> DataFrame:
    """Usable sources by kind with the check each kind stands for. ``sources`` holds
    (dataset_kind, usable)."""
    spark = sources.sparkSession
    kinds = spark.createDataFrame([(k,) for k in [*SOURCE_DOMAINS, "github_code_corpus_not_workflow"]], "dataset_kind string")
    counts = sources.groupBy("dataset_kind").agg(F.count_if("usable").alias("usable"), F.count("*").alias("found"))
    rows = kinds.join(counts, "dataset_kind", "left").select(
        "dataset_kind", F.coalesce("usable", F.lit(0)).alias("usable"), F.coalesce("found", F.lit(0)).alias("found")
    )
    code = (
        F.when((F.col("dataset_kind") == "gharchive_public_events") & (F.col("usable") == 0), "gharchive_source_missing")
        .when((F.col("dataset_kind") == "email_workflow_manifest") & (F.col("usable") == 0), "email_manifest_missing")
        .when((F.col("dataset_kind") == "github_code_corpus_not_workflow") & (F.col("found") > 0), "github_code_corpus_not_workflow")
    )
    status = F.when(code == "gharchive_source_missing", "fail").when(code.isNotNull(), "warn").otherwise("pass")
    return rows.withColumn("code", F.coalesce(code, F.lit(""))).withColumn("status", status)
