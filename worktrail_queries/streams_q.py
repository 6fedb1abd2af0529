"""Streaming forms, drained once over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.functions.ids import iso_seconds
from worktrail.session import pinned, scratch_path
from worktrail.sources import bridge
from worktrail.sources.raw_events import light_events
from worktrail.streaming import streams as W
from worktrail_queries.inputs import read
from worktrail_queries.registry import query
from worktrail_queries.sqlkit import COUNTS, iso

_stream_counts = COUNTS.replace(
    "CASE WHEN count(*) FILTER (f_emerg) > 0 THEN count(*) FILTER (f_emerg) ELSE count(*) FILTER (f_neg) END", "count(*) FILTER (f_emerg OR f_neg)"
).partition(",\n  count(DISTINCT actor)")[0]
_NAMES = ["events", *W.COUNTS, "negative_boundary"]


#: Events arrive in four parts by day; some of the first days come with the last part.
_PART = "least(3, (day(ts) - 1) {div} 8)"
_LATE = "event_id % 50 = 7 AND day(ts) <= {last}"


def _arriving(rows, path, run, parts=4):
    """Write the parts of a table one after another, and drain the stream after each: every
    part is a run of its own that goes on from the state of the run before."""
    told = []
    for part in range(parts):
        rows.filter(F.col("part") == part).write.mode("append").parquet(f"{path}/in")
        told += run(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{path}/in"))
    return told


def _parted(spark, sf, last):
    """The events table with the part in which each event arrives."""
    late = F.expr(_LATE.format(last=last))
    return read(spark, sf, "events").withColumn("part", F.when(late, 3).otherwise(F.expr(_PART.format(div="div"))).cast("int"))


def _events(stream):
    return light_events(bridge.from_table(stream.drop("part")))


@query("stream_signal_counts", f"SELECT repo, {_stream_counts} FROM fl GROUP BY repo")
def stream_signal_counts(spark, sf):
    """People are estimated in a stream, so that column is left out of the check."""
    path = scratch_path(spark, "stream-counts")
    counted = lambda stream: W.signal_counts(_events(stream))
    _arriving(_parted(spark, sf, 8), path, lambda stream: W.run_updates(counted(stream), path, ["repo"]))
    return W.latest(spark, path, counted(read(spark, sf, "events")).schema).select("repo", *_NAMES)


@query(
    "stream_window_profile",
    f"""SELECT repo, {iso("time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01')")} AS window_start, {_stream_counts}
        FROM fl WHERE NOT (CAST(ord AS BIGINT) % 50 = 7 AND day(ts) <= 6) GROUP BY repo, window_start""",
)
def stream_window_profile(spark, sf):
    """Events that come weeks late are dropped; their windows are closed."""
    path = scratch_path(spark, "stream-windows")
    profiled = lambda stream: W.window_profile(_events(stream))
    _arriving(_parted(spark, sf, 6), path, lambda stream: W.run_updates(profiled(stream), path, ["repo", "window_start"]))
    rows = W.latest(spark, path, profiled(read(spark, sf, "events")).schema)
    return rows.select("repo", iso_seconds(F.col("window_start")).alias("window_start"), *_NAMES)


# Predictions: the first event of a user, kind and part stands for a prediction row. Probes of
# some users were answered in an earlier run; rows of the first days that come with the last
# part belong to projects of their own and are too late to be taken.
_DEDUPE = f"""WITH e AS (SELECT *, {_LATE.format(last=4)} AS late FROM events),
  p AS (SELECT CASE WHEN late THEN 'late_' ELSE 'project_' END || user_id AS project_id, 'probe_' || event_type AS probe_id, CASE WHEN late THEN 3 ELSE {_PART.format(div='//')} END AS part, user_id % 10 = 3 AS answered,
    min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS prediction_id FROM e GROUP BY ALL),
  f AS (SELECT project_id, probe_id, min(part) AS part, arg_min(prediction_id, part) AS prediction_id, arg_min(ts, part) AS ts, count(*) > 1 AS came_again FROM p
    WHERE NOT answered AND project_id LIKE 'project%' GROUP BY ALL)"""
_TAKEN: dict = {}


def _deduped(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TAKEN:
        path = scratch_path(spark, "stream-dedupe")
        events = _parted(spark, sf, 4).withColumn("late", F.expr(_LATE.format(last=4)))
        first = F.min_by("event_id", F.struct("ts", "event_id")).cast("string").alias("prediction_id")
        named = F.concat(F.when(F.col("late"), "late_").otherwise("project_"), "user_id").alias("project_id")
        rows = events.groupBy(named, F.concat(F.lit("probe_"), "event_type").alias("probe_id"), "part").agg(F.min("ts").cast("timestamp").alias("ts"), first)
        answered = read(spark, sf, "events").filter("user_id % 10 = 3").select(
            F.explode(F.array(F.concat(F.lit("project_"), "user_id"), F.concat(F.lit("late_"), "user_id"))).alias("project_id"), F.concat(F.lit("probe_"), "event_type").alias("probe_id")
        )
        told = _arriving(pinned(rows), path, lambda stream: W.run_append(W.first_predictions(stream, "12 days", answered), path))
        _TAKEN[key] = rows, spark.read.parquet(f"{path}/rows"), told
    return _TAKEN[key]


@query(
    "stream_prediction_dedupe",
    f"{_DEDUPE} SELECT project_id, probe_id, CAST(part AS INTEGER) AS part, CAST(prediction_id AS VARCHAR) AS prediction_id, came_again FROM f",
)
def stream_prediction_dedupe(spark, sf):
    """Which row stays per project and probe, whatever later runs bring."""
    rows, taken, _ = _deduped(spark, sf)
    again = rows.groupBy("project_id", "probe_id").agg((F.count("*") > 1).alias("came_again"))
    return taken.join(again, ["project_id", "probe_id"]).select("project_id", "probe_id", "part", "prediction_id", "came_again")


@query(
    "stream_state",
    f"""{_DEDUPE} SELECT 'late_rows' AS measure, (SELECT count(*) FROM p WHERE NOT answered AND project_id LIKE 'late%') AS n
        UNION ALL SELECT 'taken', count(*) FROM f
        UNION ALL SELECT 'state_at_end', count(*) FROM f WHERE ts + INTERVAL 12 DAYS > (SELECT max(ts) FROM p WHERE NOT answered) - INTERVAL 12 DAYS""",
)
def stream_state(spark, sf):
    """Rows dropped as too late, rows taken, and the state that is left once the watermark has
    passed most of them."""
    _, taken, told = _deduped(spark, sf)
    counts = [("late_rows", sum(p["late"] for p in told)), ("state_at_end", told[-1]["state"])]
    fixed = spark.createDataFrame(counts, "measure string, n long")
    return fixed.unionByName(taken.agg(F.count("*").alias("n")).withColumn("measure", F.lit("taken")))
