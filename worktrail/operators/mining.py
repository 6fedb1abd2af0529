"""Rule candidates per repository, with bounded evidence in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worktrail.functions.ids import confidence, reviewer_slug, safe_condition
from worktrail.functions.text import no_strings, str_array
from worktrail.operators.ordering import joined_list, top_rows
from worktrail.operators.profile import flag_signals

EVIDENCE_SIGNALS = ["pr_or_comment", "summary", "routing", "review", "ci", "execution_boundary", "merge", "emergency", "plain_negative"]
# Labels looked for in comments, and words that make the author an owner.
COMMENT_LABELS = ["bug", "docs", "security", "api", "question"]
OWNER_MARKERS = ["triage", "assign", "owner", "route", "label"]


def first_evidence(events: DataFrame, n: int = 3, order: tuple[str, ...] = ("ts", "ord")) -> DataFrame:
    """Per repository, the first n event ids of each signal as one array per signal."""
    flagged = flag_signals(events)
    signals = F.array_compact(F.array(*[F.when(F.col(f"is_{s}"), F.lit(s)) for s in EVIDENCE_SIGNALS]))
    # The outer form keeps the optimizer from repeating the flags in an inferred filter.
    hits = flagged.select("repo", *order, "event_id", F.explode_outer(signals).alias("signal")).filter("signal is not null")
    firsts = top_rows(hits, ["repo", "signal"], [F.col(c) for c in order], n)
    return firsts.groupBy("repo").agg(
        *[joined_list(F.col("rn"), F.col("event_id"), F.col("signal") == s).alias(f"first_{s}") for s in EVIDENCE_SIGNALS]
    )


def first_reviewer() -> Column:
    return F.expr("min_by(actor, struct(ts, ord)) filter (where is_review)")


def signal_totals(events: DataFrame, order: tuple[str, ...] = ("ts", "ord")) -> DataFrame:
    flagged = flag_signals(events)
    place = "struct(" + ", ".join(order) + ")"
    return flagged.groupBy("repo").agg(
        F.count("*").alias("events"),
        *[F.count_if(f"is_{s}").alias(f"n_{s}") for s in EVIDENCE_SIGNALS],
        F.expr(f"min_by(actor, {place}) filter (where is_review)").alias("reviewer"),
        F.expr(f"max_by(event_id, {place}) filter (where is_ci)").alias("last_ci"),
    )


def evidence_by_repo(events: DataFrame, n: int = 3, order: tuple[str, ...] = ("ts", "ord")) -> DataFrame:
    """Totals and first evidence side by side; both are grouped by repo, so the join
    needs no further shuffle."""
    empty = no_strings()
    out = signal_totals(events, order).join(first_evidence(events, n, order), "repo", "left")
    for s in EVIDENCE_SIGNALS:
        out = out.withColumn(f"first_{s}", F.coalesce(f"first_{s}", empty))
    return (
        out.withColumn("has_emergency", F.col("n_emergency") > 0)
        .withColumn("n_negative", F.when(F.col("has_emergency"), F.col("n_emergency")).otherwise(F.col("n_plain_negative")))
        .withColumn("first_negative", F.when(F.col("has_emergency"), F.col("first_emergency")).otherwise(F.col("first_plain_negative")))
    )


def _let(value: Column, use) -> Column:
    """Bind a costly expression once, so that a rule may use it more than once."""
    return F.transform(F.array(value), use)[0]


def _named(content: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(F.lower(content), F.lit(pattern), F.lit(1))
    parts = F.flatten(F.transform(found, lambda m: F.transform(F.split(m, "[|,;/]+"), lambda x: F.trim(x))))
    return F.filter(parts, lambda x: x != "")


def labels_and_owners(event_type: Column, content: Column, actor: Column) -> tuple[Column, Column]:
    """Labels and owners an issue or a comment names; a comment may fall back to known
    words and to its own author."""
    is_comment = event_type == "github_issue_comment"

    def labels_of(text: Column) -> Column:
        named = F.array_distinct(F.transform(_named(text, "labels?=([a-z0-9_.:/ -]+)"), safe_condition))
        known = F.array_compact(F.array(*[F.when(F.lower(text).contains(w), F.lit(w)) for w in COMMENT_LABELS]))
        return _let(named, lambda got: F.when(is_comment & (F.size(got) == 0), known).otherwise(got))

    def owners_of(text: Column) -> Column:
        low = F.lower(text)
        single = F.filter(F.regexp_extract_all(low, F.lit("assignee=([a-z0-9_.:/-]+)"), F.lit(1)), lambda x: x != "")
        named = F.array_distinct(F.concat(_named(text, "assignees?=([a-z0-9_.:/ -]+)"), single))
        author = F.when(low.rlike("|".join(OWNER_MARKERS)), F.array(actor)).otherwise(no_strings())
        return _let(named, lambda got: F.when(is_comment & (F.size(got) == 0), author).otherwise(got))

    return _let(content, labels_of), _let(content, owners_of)


def triage_pairs(events: DataFrame, max_pairs: int = 3, max_events: int = 4) -> DataFrame:
    """First label and owner pairs per repository, each with its first events."""
    issues = events.filter(F.col("event_type").isin("github_issue", "github_issue_comment"))
    labels, owners = labels_and_owners(F.col("event_type"), F.col("content"), F.col("actor"))
    named = issues.select("repo", "ts", "ord", "event_id", labels.alias("labels"), owners.alias("owners"))
    pairs = (
        named.withColumn("label", F.explode_outer("labels"))
        .withColumn("owner", F.explode_outer("owners"))
        .filter("label <> '' and owner <> ''")
        .select("repo", "label", "owner", "ts", "ord", "event_id")
    )
    few = top_rows(pairs, ["repo", "label", "owner"], [F.col("ts"), F.col("ord")], max_events)
    grouped = few.groupBy("repo", "label", "owner").agg(joined_list(F.col("rn"), F.col("event_id")).alias("supporting_events"))
    return top_rows(grouped, ["repo"], [F.col("label"), F.col("owner")], max_pairs, "pair_rank")


def _boundary(allowed: Column, forbidden: Column, conditions: Column, tools: list[str]) -> Column:
    none = no_strings()
    return F.struct(
        allowed.alias("allowed_actions"),
        forbidden.alias("forbidden_actions"),
        conditions.alias("conditions"),
        none.alias("exceptions"),
        none.alias("requires_approval"),
        none.alias("requires_clarification"),
        str_array(tools).alias("authorized_tools"),
        none.alias("forbidden_tools"),
    )


def _candidate(
    rank: Column, suffix: Column, kind: str, policy: Column, score: Column, support: Column, negative: Column,
    boundary: Column, tasks: list[str], rule: Column,
) -> Column:
    return F.struct(
        rank.cast("int").alias("rank"),
        F.concat(F.lit("candidate_"), F.col("repo_condition"), suffix).alias("candidate_id"),
        F.lit(kind).alias("candidate_type"),
        policy.alias("policy"),
        confidence(score).alias("confidence"),
        support.alias("supporting_events"),
        negative.alias("negative_events"),
        boundary.alias("action_boundary"),
        str_array(tasks).alias("future_tasks"),
        rule.alias("mining_rule"),
    )


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def mine_candidates(events: DataFrame) -> DataFrame:
    """Routing, gate, negative and triage rules that the evidence of a repository backs."""
    base = evidence_by_repo(events).withColumn("repo_condition", safe_condition(F.col("repo")))
    repo, cond = F.col("repo"), F.col("repo_condition")
    none = no_strings()
    routing = F.array_distinct(F.concat("first_summary", "first_routing"))
    emergency = F.col("has_emergency")
    either = lambda a, b: F.when(emergency, F.lit(a)).otherwise(F.lit(b))

    review_rule = F.when(
        (F.size(routing) > 0) & (F.col("n_review") > 0),
        _candidate(
            F.lit(1),
            F.lit("_summary_review_routing"),
            "contextual_policy",
            _say("For low-risk documentation PRs in ", repo, ", add a summary comment and route review to ", F.col("reviewer"), "."),
            F.lit(0.55) + F.lit(0.08) * F.size(routing) + F.lit(0.06) * F.col("n_review"),
            F.array_distinct(F.concat(routing, F.col("first_review"))),
            none,
            _boundary(
                F.array(F.lit("add_summary_comment"), _say("request_", reviewer_slug(F.col("reviewer")), "_review")),
                str_array(["merge_before_review"]),
                F.array(cond, F.lit("low_risk_documentation_pr")),
                ["github"],
            ),
            ["tool_action_policy_alignment", "github_pr_routing"],
            F.lit("summary_or_pr_body_routing_instruction + review_event"),
        ),
    )
    ci_rule = F.when(
        F.col("n_ci") > 0,
        _candidate(
            F.lit(2),
            F.lit("_ci_before_merge"),
            "authorization_boundary",
            _say("For ", repo, " pull requests, wait for CI success before merging."),
            F.lit(0.6) + F.lit(0.08) * F.col("n_ci") + F.lit(0.05) * F.col("n_merge"),
            F.array_distinct(F.concat("first_ci", "first_merge")),
            none,
            _boundary(
                str_array(["wait_for_ci", "merge_after_ci_success"]),
                str_array(["merge_before_ci_success"]),
                str_array(["pull_request_ci_in_progress"]),
                ["github", "ci"],
            ),
            ["workflow_boundary_respect", "tool_action_policy_alignment"],
            F.lit("ci_status_event (+ optional merge event)"),
        ),
    ).when(
        F.col("n_execution_boundary") > 0,
        _candidate(
            F.lit(2),
            F.lit("_execution_boundary_before_merge"),
            "authorization_boundary",
            _say(
                "For ", repo,
                " pull requests, treat observed merge/closed/blocked workflow signals as execution boundaries before applying agent actions.",
            ),
            F.lit(0.52) + F.lit(0.07) * F.col("n_execution_boundary") + F.lit(0.04) * F.col("n_merge"),
            F.array_distinct(F.concat("first_execution_boundary", "first_merge")),
            none,
            _boundary(
                str_array(["respect_execution_boundary", "merge_after_observed_boundary_conditions"]),
                str_array(["merge_without_boundary_check"]),
                str_array(["pull_request_execution_boundary_observed"]),
                ["github"],
            ),
            ["workflow_boundary_respect", "tool_action_policy_alignment"],
            F.lit("pr_closed_merged_or_negative_boundary_event"),
        ),
    )
    negative_rule = F.when(
        F.col("n_negative") > 0,
        _candidate(
            F.lit(3),
            either("_emergency_negative_storage", "_negative_boundary_storage"),
            "negative_policy_example",
            F.when(
                emergency,
                _say("Human emergency pre-CI activity in ", repo, " must not be stored as the assistant's default merge habit."),
            ).otherwise(
                _say("Negative or blocking workflow signals in ", repo, " must be treated as boundaries, not as durable assistant habits.")
            ),
            F.lit(0.68) + F.lit(0.08) * F.col("n_negative"),
            F.col("first_negative"),
            F.col("first_negative"),
            _boundary(
                F.array(either("suppress_pre_ci_merge_as_agent_habit", "suppress_blocked_workflow_as_agent_habit")),
                F.array(either("store_human_emergency_merge_as_agent_default", "store_blocked_or_failed_action_as_default_habit")),
                F.array(either("human_emergency_hotfix", "negative_or_blocking_workflow_signal")),
                ["github", "ci"],
            ),
            ["negative_example_storage_gating"],
            either("emergency_negative_event", "negative_boundary_language_event"),
        ),
    )
    rules = base.select("repo", F.array_compact(F.array(review_rule, ci_rule, negative_rule)).alias("rules"))
    rules = rules.select("repo", F.inline_outer("rules")).filter("candidate_id is not null")

    label, owner = F.col("label"), F.col("owner")
    label_slug, owner_slug = safe_condition(label), reviewer_slug(owner)
    triage = (
        triage_pairs(events)
        .withColumn("repo_condition", safe_condition(repo))
        .select(
            "repo",
            F.inline(
                F.array(
                    _candidate(
                        F.lit(3) + F.col("pair_rank"),
                        _say("_issue_triage_", label_slug, "_", owner_slug),
                        "issue_triage_policy",
                        _say("For ", repo, " issues labeled ", label, ", route triage to ", owner, " before closing or escalating."),
                        F.lit(0.58) + F.lit(0.08) * F.size("supporting_events"),
                        F.col("supporting_events"),
                        none,
                        _boundary(
                            F.array(
                                _say("apply_", label_slug, "_label"),
                                _say("assign_", owner_slug),
                                _say("request_", owner_slug, "_triage"),
                            ),
                            str_array(["close_without_triage_owner", "escalate_without_triage_context"]),
                            F.array(cond, _say("issue_label_", label_slug)),
                            ["github", "issue_tracker"],
                        ),
                        ["issue_triage_policy_alignment", "workflow_boundary_respect"],
                        F.lit("issue_label_and_assignee_or_owner_comment"),
                    )
                )
            ),
        )
    )
    return rules.unionByName(triage)


def candidate_type_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("repo", "candidate_type").agg(F.count("*").alias("candidates"))


def type_counts_text(counts: DataFrame, key: str = "repo") -> DataFrame:
    """One row per key: total and a sorted 'type=count' list (few types per key)."""
    pair = F.concat("candidate_type", F.lit("="), F.col("candidates").cast("string"))
    return counts.groupBy(key).agg(
        F.sum("candidates").alias("candidates"), F.array_join(F.array_sort(F.collect_list(pair)), "|").alias("candidate_types")
    )


def selection_scores(profile: DataFrame, candidates: DataFrame, max_candidates_per_repo: int | None = None) -> DataFrame:
    """Eligible repositories that have candidates, with split and selection score."""
    from worktrail.functions.ids import split_of

    per_repo = type_counts_text(candidate_type_counts(candidates)).withColumnRenamed("candidates", "candidate_count")
    if max_candidates_per_repo is not None:
        per_repo = per_repo.withColumn("candidate_count", F.least("candidate_count", F.lit(max_candidates_per_repo)))
    capped = lambda name, cap, weight: F.least(F.col(name), F.lit(cap)) * weight
    return (
        profile.filter("eligible")
        .join(per_repo, "repo")
        .withColumn("split", split_of(F.col("repo")))
        .withColumn(
            "score",
            capped("candidate_count", 20, 5)
            + capped("review", 10, 3)
            + capped("execution_boundary", 10, 2)
            + capped("negative_boundary", 10, 3)
            + capped("actors", 10, 1),
        )
    )


def stratified_select(scored: DataFrame, target: int = 30, min_per_split: int = 3) -> DataFrame:
    """Fill each split's minimum in turn, then the best of the rest, up to the target.

    Only rows that can be chosen are kept from the start: the best of each split and the
    best overall, at most target + 6 * min_per_split rows.
    """
    best = [F.desc(c) for c in ("score", "candidate_count", "review", "negative_boundary", "repo")]
    heads = top_rows(scored, ["split"], best, max(min_per_split, 1), "split_rank").filter(F.col("split_rank") <= min_per_split)
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2)
    taken_before = W.partitionBy(F.lit(0)).orderBy(order, "split_rank")
    reserved = heads.withColumn("n", F.row_number().over(taken_before)).filter(F.col("n") <= target).drop("n", "split_rank")
    pool = scored.orderBy(*best).limit(target + 3 * min_per_split)
    rest = pool.join(reserved.select("repo"), "repo", "left_anti")
    marked = reserved.withColumn("turn", F.lit(0)).unionByName(rest.withColumn("turn", F.lit(1)))
    return (
        marked.withColumn("n", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("turn", *best)))
        .filter(F.col("n") <= target)
        .withColumn("reserved", F.col("turn") == 0)
        .drop("n", "turn")
    )
