"""Anchored windows and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.functions.ids import iso_seconds
from worktrail.functions.signals import COUNT_FIELDS
from worktrail.operators import profile as P
from worktrail_queries.inputs import light
from worktrail_queries.registry import query
from worktrail_queries.sqlkit import COUNTS, MISSING, iso, rnd, slug, table

table(
    "win0",
    f"""SELECT repo, window_index, anchor, {COUNTS}, min(ts) AS first_ts, max(ts) AS last_ts
FROM (SELECT *, ((epoch_us(ts) - epoch_us(anchor)) // 1000000) // 604800 AS window_index
      FROM (SELECT *, min(ts) OVER (PARTITION BY repo) AS anchor FROM fl)) GROUP BY ALL""",
)
table("win", f"SELECT *, {MISSING} AS missing_required_signals, {MISSING} = '' AS eligible FROM win0")
table(
    "spans",
    f"""SELECT repo, CAST(sum(events) AS BIGINT) AS events, count(*) AS windows_total, count(*) FILTER (eligible) AS eligible_windows,
  count(*) > 1 AS spans_multiple_windows, {rnd('(epoch_us(max(last_ts)) - epoch_us(min(first_ts))) / 1e6 / 86400.0', 3)} AS span_days,
  min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM win GROUP BY repo""",
)


@query(
    "anchored_windows",
    f"""SELECT * EXCLUDE (anchor, first_ts, last_ts), {slug('repo')} || '_w' || lpad(CAST(window_index AS VARCHAR), 4, '0') AS window_id,
          {iso('anchor + to_days(CAST(window_index * 7 AS INTEGER))')} AS window_start,
          {iso('anchor + to_days(CAST(window_index * 7 + 7 AS INTEGER))')} AS window_end,
          {iso('first_ts')} AS first_timestamp, {iso('last_ts')} AS last_timestamp FROM win""",
)
def anchored_windows(spark, sf):
    return P.anchored_windows(light(spark, sf)).select(
        "repo", "window_id", "window_index", "eligible", F.array_join("missing_required_signals", "|").alias("missing_required_signals"),
        *COUNT_FIELDS, "window_start", "window_end", iso_seconds(F.col("first_ts")).alias("first_timestamp"),
        iso_seconds(F.col("last_ts")).alias("last_timestamp"),
    )


@query(
    "repo_span",
    f"SELECT * EXCLUDE (first_ts, last_ts), {iso('first_ts')} AS first_timestamp, {iso('last_ts')} AS last_timestamp FROM spans",
)
def repo_span(spark, sf):
    return P.repo_spans(P.anchored_windows(light(spark, sf))).select(
        "repo", "events", "windows_total", "eligible_windows", "spans_multiple_windows", "span_days",
        iso_seconds(F.col("first_ts")).alias("first_timestamp"), iso_seconds(F.col("last_ts")).alias("last_timestamp"),
    )
