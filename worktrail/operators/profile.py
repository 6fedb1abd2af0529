"""Per-repository and per-window signal profiles of light events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.functions.ids import exact_round, iso_seconds, safe_condition
from worktrail.functions.signals import missing_signals, signal_columns
from worktrail.operators.ordering import beside


def flag_signals(events: DataFrame) -> DataFrame:
    """Events with their signals. Rows that hold them already stay as they are, so that a table
    written with its signals needs no texts."""
    flags = signal_columns()
    return events if set(flags) <= set(events.columns) else events.withColumns(flags)


def _count_aggs() -> list[Column]:
    """Nine counts in one pass. The negative count falls back inside the group: with any
    emergency event only those count, else the plain negative ones."""
    emergencies = F.count_if("is_emergency")
    return [
        F.count("*").alias("events"),
        F.count_if("is_pr_or_comment").alias("pr_or_comment"),
        F.count_if("is_review").alias("review"),
        F.count_if("is_ci").alias("ci"),
        F.count_if("is_execution_boundary").alias("execution_boundary"),
        F.count_if("is_merge").alias("merge"),
        emergencies.alias("emergency_negative"),
        F.when(emergencies > 0, emergencies).otherwise(F.count_if("is_plain_negative")).alias("negative_boundary"),
        F.count_distinct("actor").alias("actors"),
    ]


def signal_counts(events: DataFrame, *keys: str) -> DataFrame:
    return flag_signals(events).groupBy(*keys).agg(*_count_aggs())


def negative_fallback(events: DataFrame, key: str = "repo") -> DataFrame:
    """Events that count as negative boundaries of their group. The group flag is a
    small aggregate that joins back, so that no group has to fit one task."""
    flagged = flag_signals(events)
    groups = flagged.filter("is_emergency").select(key).distinct().withColumn("has_emergency", F.lit(True))
    return (
        flagged.filter("is_emergency or is_plain_negative")
        .join(groups, key, "left")
        .filter("is_emergency or has_emergency is null")
        .drop("has_emergency")
    )


def quality_profile(events: DataFrame) -> DataFrame:
    """Signal counts, missing signals and eligibility per repository."""
    out = flag_signals(events).groupBy("repo").agg(*_count_aggs(), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    out = out.withColumn("missing_required_signals", missing_signals())
    return out.withColumn("eligible", F.size("missing_required_signals") == 0)


def quality_summary(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.count("*").alias("repos_total"),
        F.count_if("eligible").alias("repos_eligible"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events_total"),
    )


def rank_counts(events: DataFrame) -> DataFrame:
    """The counts of the ranking report: here an event is negative by itself, with no
    fallback inside the group."""
    return (
        flag_signals(events)
        .groupBy("repo")
        .agg(
            F.count("*").alias("events"),
            F.count_if("is_pr_or_comment").alias("pr_or_comment"),
            F.count_if("is_review").alias("review"),
            F.count_if("is_ci").alias("ci"),
            F.count_if("is_execution_boundary").alias("execution_boundary"),
            F.count_if("is_merge").alias("merge"),
            F.count_if("is_emergency").alias("emergency_negative"),
            F.count_if(F.col("is_emergency") | F.col("is_plain_negative")).alias("negative_boundary"),
            F.count_distinct("actor").alias("actors"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min("ord").alias("first_ord"),
        )
    )


def rank_repos(events: DataFrame, limit: int = 100, min_events: int = 1) -> DataFrame:
    """Best repositories by capped, weighted signals; equal keys keep first-seen order."""
    missing = missing_signals()
    capped = lambda name, cap, weight: F.least(F.col(name), F.lit(cap)) * weight
    scored = (
        rank_counts(events)
        .filter(F.col("events") >= min_events)
        .withColumn("missing_required_signals", missing)
        .withColumn("eligible", F.size("missing_required_signals") == 0)
        .withColumn(
            "score",
            capped("pr_or_comment", 5, 2)
            + capped("review", 5, 3)
            + capped("execution_boundary", 5, 2)
            + capped("negative_boundary", 5, 3)
            + capped("merge", 3, 1)
            + capped("actors", 5, 1),
        )
    )
    keys = ["eligible", "score", "events", "review", "execution_boundary", "negative_boundary"]
    return scored.orderBy(*[F.desc(k) for k in keys], F.asc("first_ord")).limit(limit)


def with_window_index(events: DataFrame, window_days: int = 7) -> DataFrame:
    """Window number counted from the first event of the repository, not from the epoch."""
    anchors = events.groupBy("repo").agg(F.min("ts").alias("anchor"))
    offset = F.floor((F.unix_micros("ts") - F.unix_micros("anchor")) / F.lit(1_000_000))
    return events.join(anchors, "repo").withColumn(
        "window_index", F.floor(F.greatest(F.lit(0), offset) / F.lit(window_days * 86400)).cast("long")
    )


def anchored_windows(events: DataFrame, window_days: int = 7) -> DataFrame:
    indexed = with_window_index(events, window_days)
    out = (
        flag_signals(indexed)
        .groupBy("repo", "window_index")
        .agg(*_count_aggs(), F.min("anchor").alias("anchor"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    day = F.make_dt_interval(F.lit(1))
    start = F.col("anchor") + day * (F.col("window_index") * window_days)
    return (
        out.withColumn("missing_required_signals", missing_signals())
        .withColumn("eligible", F.size("missing_required_signals") == 0)
        .withColumn(
            "window_id",
            F.concat(
                safe_condition(F.col("repo")),
                F.lit("_w"),
                F.when(F.length(F.col("window_index").cast("string")) >= 4, F.col("window_index").cast("string")).otherwise(
                    F.lpad(F.col("window_index").cast("string"), 4, "0")
                ),
            ),
        )
        .withColumn("window_start", iso_seconds(start))
        .withColumn("window_end", iso_seconds(start + day * F.lit(window_days)))
    )


def repo_spans(windows: DataFrame) -> DataFrame:
    """How far the evidence of a repository spreads over its windows."""
    out = windows.groupBy("repo").agg(
        F.sum("events").alias("events"),
        F.count("*").alias("windows_total"),
        F.count_if("eligible").alias("eligible_windows"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    seconds = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1e6)
    return out.withColumn("spans_multiple_windows", F.col("windows_total") > 1).withColumn(
        "span_days", exact_round(seconds / F.lit(86400.0), 3)
    )


def window_summary(windows: DataFrame, spans: DataFrame) -> DataFrame:
    totals = windows.agg(F.count("*").alias("windows_total"), F.count_if("eligible").alias("eligible_windows"))
    by_repo = spans.agg(
        F.count("*").alias("repos_total"),
        F.count_if(F.col("eligible_windows") > 0).alias("repos_with_eligible_windows"),
        F.count_if("spans_multiple_windows").alias("repos_spanning_multiple_windows"),
    )
    return beside(totals, by_repo)
