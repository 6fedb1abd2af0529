"""Evidence, triage pairs, rule candidates and repository selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.operators import mining as M
from worktrail.operators import profile as P
from worktrail_queries.inputs import candidates, light, profile
from worktrail_queries.registry import query
from worktrail_queries.sqlkit import has_any, rnd, slug, sql_list, table

table(
    "ev_sig",
    """SELECT repo, ord, ts, event_id, unnest(list_filter([
    CASE WHEN f_pr THEN 'pr_or_comment' END, CASE WHEN f_summary THEN 'summary' END, CASE WHEN f_routing THEN 'routing' END, CASE WHEN f_review THEN 'review' END,
    CASE WHEN f_ci THEN 'ci' END, CASE WHEN f_exec THEN 'execution_boundary' END, CASE WHEN f_merge THEN 'merge' END,
    CASE WHEN f_emerg THEN 'emergency' END, CASE WHEN f_neg THEN 'plain_negative' END], lambda s: s IS NOT NULL)) AS signal FROM fl""",
)
table("first3", "SELECT repo, signal, list(event_id ORDER BY ts, ord)[:3] AS ids FROM ev_sig GROUP BY repo, signal")
_first = ", ".join(
    f"coalesce(any_value(ids) FILTER (signal = '{s}'), []) AS first_{s}" for s in M.EVIDENCE_SIGNALS
)
table(
    "evid",
    f"""SELECT t.*, f.* EXCLUDE (repo), n_emerg > 0 AS has_e, CASE WHEN n_emerg > 0 THEN n_emerg ELSE n_neg END AS n_negative,
  CASE WHEN n_emerg > 0 THEN first_emergency ELSE first_plain_negative END AS first_negative, {slug('t.repo')} AS cond
FROM (SELECT repo, count(*) FILTER (f_review) AS n_review, count(*) FILTER (f_ci) AS n_ci, count(*) FILTER (f_exec) AS n_exec,
        count(*) FILTER (f_merge) AS n_merge, count(*) FILTER (f_emerg) AS n_emerg, count(*) FILTER (f_neg) AS n_neg,
        first(actor ORDER BY ts, ord) FILTER (f_review) AS reviewer FROM fl GROUP BY repo) t
JOIN (SELECT repo, {_first} FROM first3 GROUP BY repo) f ON t.repo = f.repo""",
)


def _uniq(items: str) -> str:
    """Order-keeping distinct."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


table(
    "tri0",
    f"""SELECT repo, ts, ord, event_id, event_type, actor, lower(content) AS low,
  list_transform(regexp_extract_all(lower(content), 'labels?=([a-z0-9_.:/ -]+)', 1), lambda m: trim(m)) AS l0,
  list_transform(regexp_extract_all(lower(content), 'assignees?=([a-z0-9_.:/ -]+)', 1), lambda m: trim(m)) AS o0
FROM ev WHERE event_type IN ('github_issue', 'github_issue_comment')""",
)
table(
    "tri",
    f"""SELECT repo, ts, ord, event_id,
  CASE WHEN event_type = 'github_issue_comment' AND len(l0) = 0 THEN list_filter({sql_list(M.COMMENT_LABELS)}, lambda w: contains(low, w))
       ELSE list_distinct(l0) END AS labels,
  CASE WHEN event_type = 'github_issue_comment' AND len(o0) = 0 THEN CASE WHEN {has_any('low', M.OWNER_MARKERS)} THEN [actor] ELSE [] END
       ELSE list_distinct(o0) END AS owners FROM tri0""",
)
table(
    "tripairs",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY label, owner) AS pair_rank FROM (
  SELECT repo, label, owner, list(event_id ORDER BY ts, ord)[:4] AS supporting_events
  FROM (SELECT repo, ts, ord, event_id, label, unnest(owners) AS owner FROM (SELECT *, unnest(labels) AS label FROM tri))
  GROUP BY repo, label, owner)) WHERE pair_rank <= 3""",
)
_routing = "list_concat(first_summary, first_routing)"


def _conf(expr: str) -> str:
    return rnd(f"least(0.95e0, greatest(0.1e0, {expr}))", 3)


table("evid2", f"SELECT *, {_uniq(_routing)} AS routing, regexp_replace({slug('reviewer')}, '(_reviewer|_review)$', '') AS rslug FROM evid")
_sup = "list_concat(routing, first_review)"
_cisup = "list_concat(first_ci, first_merge)"
_exsup = "list_concat(first_execution_boundary, first_merge)"
table(
    "cand",
    f"""SELECT 1 AS rank, repo, 'candidate_' || cond || '_summary_review_routing' AS candidate_id, 'contextual_policy' AS candidate_type,
  'For low-risk documentation PRs in ' || repo || ', add a summary comment and route review to ' || reviewer || '.' AS policy,
  {_conf('0.55e0 + 0.08e0 * len(routing) + 0.06e0 * n_review')} AS confidence, {_uniq(_sup)} AS supporting_events,
  CAST([] AS VARCHAR[]) AS negative_events, ['add_summary_comment', 'request_' || rslug || '_review'] AS allowed_actions,
  ['merge_before_review'] AS forbidden_actions, [cond, 'low_risk_documentation_pr'] AS conditions, ['github'] AS authorized_tools,
  ['tool_action_policy_alignment', 'github_pr_routing'] AS future_tasks, 'summary_or_pr_body_routing_instruction + review_event' AS mining_rule
FROM evid2 WHERE len(routing) > 0 AND n_review > 0
UNION ALL
SELECT 2, repo, 'candidate_' || cond || '_ci_before_merge', 'authorization_boundary',
  'For ' || repo || ' pull requests, wait for CI success before merging.', {_conf('0.6e0 + 0.08e0 * n_ci + 0.05e0 * n_merge')},
  {_uniq(_cisup)}, [], ['wait_for_ci', 'merge_after_ci_success'], ['merge_before_ci_success'], ['pull_request_ci_in_progress'],
  ['github', 'ci'], ['workflow_boundary_respect', 'tool_action_policy_alignment'], 'ci_status_event (+ optional merge event)'
FROM evid2 WHERE n_ci > 0
UNION ALL
SELECT 2, repo, 'candidate_' || cond || '_execution_boundary_before_merge', 'authorization_boundary',
  'For ' || repo || ' pull requests, treat observed merge/closed/blocked workflow signals as execution boundaries before applying agent actions.',
  {_conf('0.52e0 + 0.07e0 * n_exec + 0.04e0 * n_merge')}, {_uniq(_exsup)}, [],
  ['respect_execution_boundary', 'merge_after_observed_boundary_conditions'], ['merge_without_boundary_check'],
  ['pull_request_execution_boundary_observed'], ['github'], ['workflow_boundary_respect', 'tool_action_policy_alignment'],
  'pr_closed_merged_or_negative_boundary_event'
FROM evid2 WHERE n_ci = 0 AND n_exec > 0
UNION ALL
SELECT 3, repo, 'candidate_' || cond || CASE WHEN has_e THEN '_emergency_negative_storage' ELSE '_negative_boundary_storage' END,
  'negative_policy_example',
  CASE WHEN has_e THEN 'Human emergency pre-CI activity in ' || repo || ' must not be stored as the assistant''s default merge habit.'
    ELSE 'Negative or blocking workflow signals in ' || repo || ' must be treated as boundaries, not as durable assistant habits.' END,
  {_conf('0.68e0 + 0.08e0 * n_negative')}, first_negative, first_negative,
  CASE WHEN has_e THEN ['suppress_pre_ci_merge_as_agent_habit'] ELSE ['suppress_blocked_workflow_as_agent_habit'] END,
  CASE WHEN has_e THEN ['store_human_emergency_merge_as_agent_default'] ELSE ['store_blocked_or_failed_action_as_default_habit'] END,
  CASE WHEN has_e THEN ['human_emergency_hotfix'] ELSE ['negative_or_blocking_workflow_signal'] END, ['github', 'ci'],
  ['negative_example_storage_gating'], CASE WHEN has_e THEN 'emergency_negative_event' ELSE 'negative_boundary_language_event' END
FROM evid2 WHERE n_negative > 0
UNION ALL
SELECT 3 + pair_rank, repo, 'candidate_' || {slug('repo')} || '_issue_triage_' || label || '_' || owner, 'issue_triage_policy',
  'For ' || repo || ' issues labeled ' || label || ', route triage to ' || owner || ' before closing or escalating.',
  {_conf('0.58e0 + 0.08e0 * len(supporting_events)')}, supporting_events, [],
  ['apply_' || label || '_label', 'assign_' || owner, 'request_' || owner || '_triage'],
  ['close_without_triage_owner', 'escalate_without_triage_context'], [{slug('repo')}, 'issue_label_' || label], ['github', 'issue_tracker'],
  ['issue_triage_policy_alignment', 'workflow_boundary_respect'], 'issue_label_and_assignee_or_owner_comment'
FROM tripairs""",
)


@query("first_reviewer", "SELECT repo, first(actor ORDER BY ts, ord) AS reviewer FROM fl WHERE f_review GROUP BY repo")
def first_reviewer(spark, sf):
    return P.flag_signals(light(spark, sf)).groupBy("repo").agg(M.first_reviewer().alias("reviewer")).filter("reviewer is not null")


@query(
    "first_n_evidence",
    "SELECT repo, " + ", ".join(f"array_to_string(first_{s}, '|') AS first_{s}" for s in M.EVIDENCE_SIGNALS)
    + f", array_to_string({_uniq(_routing)}, '|') AS routing_events FROM evid",
)
def first_n_evidence(spark, sf):
    df = M.evidence_by_repo(light(spark, sf))
    return df.select(
        "repo", *[F.array_join(f"first_{s}", "|").alias(f"first_{s}") for s in M.EVIDENCE_SIGNALS],
        F.array_join(F.array_distinct(F.concat("first_summary", "first_routing")), "|").alias("routing_events"),
    )


@query("triage_pairs", "SELECT repo, label, owner, CAST(pair_rank AS BIGINT) AS pair_rank, array_to_string(supporting_events, '|') AS supporting_events FROM tripairs")
def triage_pairs(spark, sf):
    return M.triage_pairs(light(spark, sf)).select(
        "repo", "label", "owner", F.col("pair_rank").cast("bigint").alias("pair_rank"),
        F.array_join("supporting_events", "|").alias("supporting_events"),
    )


_LISTS = ["supporting_events", "negative_events", "allowed_actions", "forbidden_actions", "conditions", "authorized_tools", "future_tasks"]
_CAND_SQL = "rank, repo, candidate_id, candidate_type, policy, confidence, mining_rule, " + ", ".join(
    f"array_to_string({c}, '|') AS {c}" for c in _LISTS
)


def flat_candidates(df):
    b = ["allowed_actions", "forbidden_actions", "conditions", "authorized_tools"]
    return df.select(
        F.col("rank").cast("bigint").alias("rank"), "repo", "candidate_id", "candidate_type", "policy", "confidence", "mining_rule",
        *[F.array_join(f"action_boundary.{c}" if c in b else c, "|").alias(c) for c in _LISTS],
    )


@query("mine_candidates", f"SELECT {_CAND_SQL.replace('rank,', 'CAST(rank AS BIGINT) AS rank,', 1)} FROM cand")
def mine_candidates(spark, sf):
    return flat_candidates(M.mine_candidates(light(spark, sf)))


@query("candidate_type_counts", "SELECT repo, candidate_type, count(*) AS candidates FROM cand GROUP BY ALL")
def candidate_type_counts(spark, sf):
    return M.candidate_type_counts(candidates(spark, sf))


table(
    "candrep",
    """SELECT repo, CAST(sum(n) AS BIGINT) AS candidate_count, string_agg(candidate_type || '=' || n, '|' ORDER BY candidate_type || '=' || n) AS candidate_types
FROM (SELECT repo, candidate_type, count(*) AS n FROM cand GROUP BY ALL) GROUP BY repo""",
)


def bucket_sql(text: str) -> str:
    digits = (
        f"list_sum(list_transform(string_split(substr(sha256({text}), 1, 63), ''), "
        "lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT)))"
    )
    return f"CAST((6 * {digits} + instr('0123456789abcdef', substr(sha256({text}), 64, 1)) - 1) % 10 AS BIGINT)"


def split_sql(text: str) -> str:
    b = bucket_sql(text)
    return f"CASE WHEN {b} < 6 THEN 'train' WHEN {b} < 8 THEN 'dev' ELSE 'test' END"


table(
    "selscore",
    f"""SELECT prof.*, candidate_count, candidate_types, {split_sql('repo')} AS split,
  least(candidate_count, 20) * 5 + least(review, 10) * 3 + least(execution_boundary, 10) * 2 + least(negative_boundary, 10) * 3 + least(actors, 10) AS score
FROM prof JOIN candrep USING (repo) WHERE eligible""",
)
_BEST = "score DESC, candidate_count DESC, review DESC, negative_boundary DESC, repo DESC"
table(
    "selected",
    f"""SELECT *, row_number() OVER (ORDER BY NOT head, {_BEST}) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_BEST}) <= 3 AS head FROM selscore) QUALIFY n <= 30""",
)


@query(
    "stratified_select",
    "SELECT repo, split, CAST(score AS BIGINT) AS score, candidate_count, candidate_types, head AS reserved FROM selected",
)
def stratified_select(spark, sf):
    scored = M.selection_scores(profile(spark, sf), candidates(spark, sf))
    return M.stratified_select(scored).select(
        "repo", "split", F.col("score").cast("bigint").alias("score"), "candidate_count", "candidate_types", "reserved"
    )
