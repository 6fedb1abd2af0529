"""Shared table expressions for the check SQL. A query names the ones it needs as
``{{name}}`` in its first line; expand() adds them and all they rest on as CTEs."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {}


def table(name: str, body: str) -> None:
    TABLES[name] = body.strip()


def _needs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)) if n in TABLES]


def expand(sql: str) -> str:
    order: list[str] = []

    def visit(name: str, trail: tuple[str, ...] = ()) -> None:
        if name in order or name in trail:
            return
        for dep in _needs(TABLES[name]):
            if dep != name:
                visit(dep, trail + (name,))
        order.append(name)

    for name in _needs(sql):
        visit(name)
    sql = sql.strip()
    heads = [f"{n} AS (\n{TABLES[n]}\n)" for n in order]
    if not heads:
        return sql
    if sql[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ",\n".join(heads) + ",\n" + sql[14:].lstrip()
    if sql[:4].upper() == "WITH":
        return "WITH " + ",\n".join(heads) + ",\n" + sql[4:].lstrip()
    return "WITH " + ",\n".join(heads) + "\n" + sql


def iso(ts: str) -> str:
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({ts}) % 1000000 = 0 THEN '' "
        f"ELSE '.' || lpad(CAST(microsecond({ts}) % 1000000 AS VARCHAR), 6, '0') END || '+00:00')"
    )


def _total(inner: str) -> str:
    return f"CAST(round(sum(CAST({inner} AS DECIMAL(38,12))), 9) AS DOUBLE)"


def rnd(value: str, places: int = 4) -> str:
    """Half-even on the exact binary value; twin of exact_round. A mean or a sum at the
    start is taken in decimals, as stable_mean and stable_sum do."""
    if value.startswith("avg(") and value.endswith(")"):
        value = f"{_total(value[4:-1])} / nullif(count({value[4:-1]}), 0)"
    elif value.startswith("sum(") and ") / " in value:
        at = value.rindex(") / ")
        value = _total(value[4:at]) + value[at + 1 :]
    c = f"{2 * 10**places}e0"
    high = "(v * 134217729e0 - (v * 134217729e0 - v))"
    err = f"(({high} * {c} - v * {c}) + (v - {high}) * {c})"
    down = f"floor(v * {c} / 2)"
    beyond = f"((v * {c} - ({down} * 2 + 1)) + {err})"
    return (
        f"list_transform([CAST({value} AS DOUBLE)], lambda v: ({down} + CASE WHEN {beyond} > 0 OR ({beyond} = 0 AND CAST({down} AS BIGINT) % 2 = 1) "
        f"THEN 1 ELSE 0 END) / {10**places}e0)[1]"
    )


def slug(text: str, default: str = "value") -> str:
    """Lower-case identifier: non-alphanumerics to underscores, none at the ends."""
    return f"coalesce(nullif(trim(regexp_replace(lower({text}), '[^\\pL\\pN]', '_', 'g'), '_'), ''), '{default}')"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def has_any(text: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '" + m.replace("'", "''") + "')" for m in markers) + ")"


def words(text: str, stopwords: list[str]) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), "
        f"lambda t: t <> '' AND NOT list_contains({sql_list(stopwords)}, t))"
    )


def toks(text: str, stopwords: list[str] | None = None) -> str:
    from worktrail.functions.text import STOPWORDS

    return words(f"translate({text}, '_-', '  ')", stopwords or STOPWORDS)


table(
    "ev_base",
    """
SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE event_type WHEN 'click' THEN 'IssueCommentEvent' WHEN 'view' THEN 'PullRequestReviewEvent'
    WHEN 'purchase' THEN 'PullRequestEvent' WHEN 'signup' THEN 'IssuesEvent'
    ELSE CASE WHEN user_id % 2 = 0 THEN 'WorkflowRunEvent' ELSE 'CommitCommentEvent' END END AS raw_type
FROM events
""",
)
table(
    "ev_text",
    """
SELECT event_id AS ord, ts, k, user_id, raw_type, event_type AS kind,
  'org/repo_' || user_id AS repo, 'dev_' || (k % 7) AS actor,
  CASE WHEN k <= 7 THEN 'Summary: small docs change, please review'
       WHEN k <= 9 THEN 'Blocked: do not merge before approval'
       WHEN k = 12 AND user_id % 5 = 0 THEN 'Emergency hotfix merged before CI'
       WHEN k BETWEEN 14 AND 19 THEN 'tl;dr looks fine' ELSE 'Routine update' END AS body,
  CASE raw_type WHEN 'IssueCommentEvent' THEN 'created' WHEN 'PullRequestReviewEvent' THEN 'submitted'
    WHEN 'PullRequestEvent' THEN CASE WHEN k % 2 = 0 THEN 'closed' ELSE 'opened' END
    WHEN 'IssuesEvent' THEN 'labeled' WHEN 'WorkflowRunEvent' THEN 'completed' END AS action,
  CASE raw_type WHEN 'IssueCommentEvent' THEN 'github_issue_comment' WHEN 'PullRequestReviewEvent' THEN 'github_pr_review'
    WHEN 'PullRequestEvent' THEN 'github_pull_request' WHEN 'IssuesEvent' THEN 'github_issue'
    WHEN 'WorkflowRunEvent' THEN 'github_ci_status' ELSE 'github_commit_comment' END AS event_type,
  ['bug', 'docs', 'security', 'api'][k % 4 + 1] AS label, 'owner_' || (k % 3) AS owner
FROM ev_base
""",
)
table(
    "ev",
    """
SELECT *, 'event_gharchive_' || ord AS event_id, 'artifact_gharchive_' || ord AS artifact_id,
  actor || ' ' || raw_type || coalesce('; action=' || action, '') || '; repo=' || repo || '; ' ||
  CASE raw_type
    WHEN 'PullRequestEvent' THEN 'pull_request: number=' || ord || ', title=Change ' || k || ', body=' || body
    WHEN 'IssuesEvent' THEN 'issue: number=' || ord || ', title=' || body || ', labels=' || label || ', assignee=' || owner
    WHEN 'PullRequestReviewEvent' THEN 'review: title=' || body
    WHEN 'WorkflowRunEvent' THEN 'workflow_run: title=ci, status=' || CASE WHEN k % 2 = 0 THEN 'success' ELSE 'failure' END
    ELSE 'comment: title=' || body END AS content,
  list_filter([event_type, event_type || '_' || action,
    CASE WHEN event_type = 'github_ci_status' THEN 'ci_signal_observed' END,
    CASE WHEN event_type IN ('github_pull_request', 'github_pr_review') THEN 'pr_workflow_signal' END],
    lambda c: c IS NOT NULL) AS claims
FROM ev_text
""",
)
table(
    "entities",
    """
SELECT ord, list_sort(list_distinct(list_filter([repo, actor,
    CASE raw_type WHEN 'PullRequestEvent' THEN CASE WHEN k % 2 = 0 THEN 'closed' ELSE 'open' END
      WHEN 'PullRequestReviewEvent' THEN CASE WHEN k % 3 = 0 THEN 'approved' ELSE 'commented' END
      WHEN 'WorkflowRunEvent' THEN CASE WHEN k % 2 = 0 THEN 'success' ELSE 'failure' END
      WHEN 'IssueCommentEvent' THEN 'MEMBER' WHEN 'CommitCommentEvent' THEN 'MEMBER' END],
    lambda x: x IS NOT NULL))) AS entities
FROM ev
""",
)


def _flags() -> str:
    from worktrail.functions.signals import (
        NEGATIVE_MARKERS, NEGATIVE_TYPES, PR_OR_COMMENT, REVIEW, REVIEW_MARKERS, ROUTING_TYPES, SUMMARY_MARKERS, SUMMARY_TYPES,
    )

    low = "lower(content)"
    neg = has_any(low, NEGATIVE_MARKERS)
    return f"""
SELECT *, event_type IN {in_list(PR_OR_COMMENT)} AS f_pr, event_type IN {in_list(REVIEW)} AS f_review,
  event_type = 'github_ci_status' AS f_ci,
  event_type = 'github_pull_request' AND (list_contains(claims, 'github_pull_request_closed') OR contains({low}, 'merged')) AS f_merge,
  event_type = 'github_ci_status' OR (event_type = 'github_pull_request' AND (list_contains(claims, 'github_pull_request_closed')
    OR contains({low}, 'merged') OR {neg})) AS f_exec,
  contains({low}, 'emergency') AS f_emerg,
  event_type IN {in_list(NEGATIVE_TYPES)} AND {neg} AS f_neg, {neg} AS neg_text,
  event_type IN {in_list(SUMMARY_TYPES)} AND {has_any(low, SUMMARY_MARKERS)} AS f_summary,
  event_type IN {in_list(ROUTING_TYPES)} AND {has_any(low, SUMMARY_MARKERS)} AND {has_any(low, REVIEW_MARKERS)} AS f_routing
FROM ev
"""


table("fl", _flags())

COUNTS = """count(*) AS events, count(*) FILTER (f_pr) AS pr_or_comment, count(*) FILTER (f_review) AS review,
  count(*) FILTER (f_ci) AS ci, count(*) FILTER (f_exec) AS execution_boundary, count(*) FILTER (f_merge) AS merge,
  count(*) FILTER (f_emerg) AS emergency_negative,
  CASE WHEN count(*) FILTER (f_emerg) > 0 THEN count(*) FILTER (f_emerg) ELSE count(*) FILTER (f_neg) END AS negative_boundary,
  count(DISTINCT actor) AS actors"""
MISSING = """concat_ws('|', CASE WHEN pr_or_comment = 0 THEN 'pr_or_comment' END, CASE WHEN review = 0 THEN 'review' END,
  CASE WHEN execution_boundary = 0 THEN 'execution_boundary' END, CASE WHEN negative_boundary = 0 THEN 'negative_boundary' END)"""
table("prof0", f"SELECT repo, {COUNTS}, min(ts) AS first_ts, max(ts) AS last_ts FROM fl GROUP BY repo")
table("prof", f"SELECT *, {MISSING} AS missing_required_signals, {MISSING} = '' AS eligible FROM prof0")
