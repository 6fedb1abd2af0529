"""Workflow signals of one event: which rules its type, claims and text satisfy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark a negative or blocking boundary.
NEGATIVE_MARKERS = [
    "do not", "don't", "dont", "must not", "should not", "cannot", "can't", "blocked", "blocker", "hold", "wait for",
    "needs approval", "requires approval", "not ready", "do-not-merge", "do not merge", "wip", "work in progress",
    "revert", "rollback", "failing", "failed", "red ci", "before ci", "pre-ci",
]
SUMMARY_MARKERS = ["summary", "summarize", "tl;dr", "tl; dr"]
REVIEW_MARKERS = ["review", "reviewer", "ask ", "request "]
# Event types each rule looks at.
PR_OR_COMMENT = ["github_pull_request", "github_issue_comment", "github_pr_review", "github_pr_review_comment"]
REVIEW = ["github_pr_review", "github_pr_review_comment"]
NEGATIVE_TYPES = [
    "github_pull_request", "github_issue", "github_issue_comment", "github_pr_review", "github_pr_review_comment", "github_ci_status",
]
SUMMARY_TYPES = ["github_issue_comment", "github_pr_review_comment"]
ROUTING_TYPES = ["github_pull_request", "github_issue_comment", "github_pr_review_comment"]
REQUIRED_SIGNALS = ["pr_or_comment", "review", "execution_boundary", "negative_boundary"]
COUNT_FIELDS = [
    "events", "pr_or_comment", "review", "ci", "execution_boundary", "merge", "emergency_negative", "negative_boundary", "actors",
]


def _any_of(text: Column, markers: list[str]) -> Column:
    """Some marker stands in the text. Plain searches cost a tenth of a pattern of alternatives;
    a marker that holds another one is met with that one."""
    low = F.lower(text)
    least = [m for m in markers if not any(o != m and o in m for o in markers)]
    return reduce(lambda a, b: a | b, [low.contains(m) for m in least])


def negative_language(content: Column) -> Column:
    return _any_of(content, NEGATIVE_MARKERS)


def emergency(content: Column) -> Column:
    return F.lower(content).contains("emergency")


def merged_pr(event_type: Column, claims: Column, content: Column) -> Column:
    return (event_type == "github_pull_request") & (
        F.array_contains(claims, "github_pull_request_closed") | F.lower(content).contains("merged")
    )


def execution_boundary(event_type: Column, claims: Column, content: Column) -> Column:
    return (
        (event_type == "github_ci_status")
        | merged_pr(event_type, claims, content)
        | ((event_type == "github_pull_request") & negative_language(content))
    )


def summary_comment(event_type: Column, content: Column) -> Column:
    return event_type.isin(SUMMARY_TYPES) & _any_of(content, SUMMARY_MARKERS)


def routing_instruction(event_type: Column, content: Column) -> Column:
    return event_type.isin(ROUTING_TYPES) & _any_of(content, SUMMARY_MARKERS) & _any_of(content, REVIEW_MARKERS)


def plain_negative(event_type: Column, content: Column) -> Column:
    return event_type.isin(NEGATIVE_TYPES) & negative_language(content)


def signal_columns() -> dict[str, Column]:
    """All per-event flags over the columns event_type, claims and content."""
    t, c, x = F.col("event_type"), F.col("claims"), F.col("content")
    return {
        "is_pr_or_comment": t.isin(PR_OR_COMMENT),
        "is_review": t.isin(REVIEW),
        "is_ci": t == "github_ci_status",
        "is_execution_boundary": execution_boundary(t, c, x),
        "is_merge": merged_pr(t, c, x),
        "is_emergency": emergency(x),
        "is_plain_negative": plain_negative(t, x),
        "is_summary": summary_comment(t, x),
        "is_routing": routing_instruction(t, x),
    }


def missing_signals(counts: dict[str, Column] | None = None) -> Column:
    get = (lambda s: counts[s]) if counts else F.col
    return F.array_compact(F.array(*[F.when(get(s) <= 0, F.lit(s)) for s in REQUIRED_SIGNALS]))
