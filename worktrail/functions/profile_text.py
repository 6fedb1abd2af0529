"""Cues read from event text and probe queries: labels, people, workflow signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worktrail.functions.text import humanize, normalize_text

# Phrases counted as workflow signals, and query phrasings.
WORKFLOW_SIGNALS = ["blocked", "failed", "validation completed", "azure pipeline passed", "changes requested", "moderator approved"]
LABEL_PHRASES = [
    r"(?i)apply(?: the)? ([a-z0-9_\- ]+?) label",
    r"(?i)under the ([a-z0-9_\- ]+?) label condition",
    r"(?i)in the issue_label_([a-z0-9_\-]+) workflow",
    r"(?i)under the issue_label_([a-z0-9_\-]+) condition",
]
HANDLE_PHRASES = [r"\bassign ([A-Za-z0-9_.\-\[\]/]+)", r"\brequest ([A-Za-z0-9_.\-\[\]/]+) triage"]


def clean_label(c: Column) -> Column:
    return F.regexp_replace(humanize(c), r"^[ .:;]+|[ .:;]+$", "")


def extract_labels(content: Column) -> Column:
    """Labels up to the end of the clause; a following colon-marked part is cut off. The
    text marks assignees with '=', so that cut does not apply to them."""
    raw = F.regexp_extract_all(content, F.lit(r"(?i)labels=([^;\n]+)"), F.lit(1))
    parts = F.flatten(
        F.transform(
            raw,
            lambda m: F.split(F.split(m, r",\s*(?:assignees?|comment|review|pull_request|issue):", 2)[0], r"[|,]"),
        )
    )
    return F.filter(F.transform(parts, clean_label), lambda x: x != "")


def extract_assignees(content: Column) -> Column:
    raw = F.regexp_extract_all(content, F.lit(r"(?i)\bassignees?=([^;\n,]+)"), F.lit(1))
    parts = F.flatten(F.transform(raw, lambda m: F.split(m, r"[|,\s]+")))
    return F.filter(F.transform(parts, clean_handle), lambda x: x != "")


def clean_handle(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ .,:;()]+|[ .,:;()]+$", "")


def query_label(query: Column) -> Column:
    hits = [F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in LABEL_PHRASES]
    return F.trim(humanize(F.coalesce(*hits, F.lit(""))))


def query_assignees(query: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(query, F.lit(p), F.lit(1)) for p in HANDLE_PHRASES])
    names = F.filter(F.transform(found, clean_handle), lambda x: (x != "") & ~F.lower(x).isin("the", "a", "an"))
    return F.array_distinct(F.transform(names, humanize))


def workflow_signals(content: Column) -> Column:
    norm = normalize_text(content)
    return F.transform(
        F.array(norm),
        lambda t: F.array_compact(F.array(*[F.when(t.contains(s), F.lit(s)) for s in WORKFLOW_SIGNALS])),
    )[0]


def event_text(event_type: Column, actor: Column, content: Column, claims: Column, entities: Column) -> Column:
    """Public search text of an event: blanks are skipped."""
    blank = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", blank(event_type), blank(actor), blank(content), blank(F.array_join(claims, " ")), blank(F.array_join(entities, " ")))


def search_text(content: Column, claims: Column, tags: Column, entities: Column) -> Column:
    return F.concat(content, *[x for c in (claims, tags, entities) for x in (F.lit(" "), F.array_join(c, " "))])
