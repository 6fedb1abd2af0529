"""Running counts, windowed counts and first-wins dedupe over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.operators.profile import flag_signals

COUNTS = {
    "pr_or_comment": "is_pr_or_comment",
    "review": "is_review",
    "ci": "is_ci",
    "execution_boundary": "is_execution_boundary",
    "merge": "is_merge",
    "emergency_negative": "is_emergency",
}


def _aggs():
    return [
        F.count("*").alias("events"),
        *[F.count_if(flag).alias(name) for name, flag in COUNTS.items()],
        F.count_if(F.col("is_emergency") | F.col("is_plain_negative")).alias("negative_boundary"),
        # A stream cannot keep an exact distinct set, so people are estimated.
        F.approx_count_distinct("actor").alias("actors_estimate"),
    ]


def signal_counts(events: DataFrame) -> DataFrame:
    """Running counts per repository; each trigger emits the repositories that changed."""
    return flag_signals(events).groupBy("repo").agg(*_aggs())


def window_profile(events: DataFrame, window_days: int = 7, lateness: str = "1 day") -> DataFrame:
    """Counts per repository and epoch-aligned window, with late events up to the bound."""
    return (
        flag_signals(events.withWatermark("ts", lateness))
        .groupBy("repo", F.window("ts", f"{window_days} days").alias("w"))
        .agg(*_aggs())
        .select("repo", F.col("w.start").alias("window_start"), *["events", *COUNTS, "negative_boundary", "actors_estimate"])
    )


def first_predictions(rows: DataFrame, horizon: str, answered: DataFrame | None = None) -> DataFrame:
    """The first row per probe inside the horizon; later ones are dropped. Probes that an earlier
    run has answered (``answered``: project_id, probe_id, a table) are left out before any state
    is kept. Rows older than the watermark are dropped, and so is the state of probes whose
    first row is further back than twice the horizon."""
    keys = ["project_id", "probe_id"]
    if answered is not None:
        rows = rows.join(answered.select(*keys).distinct(), keys, "left_anti")
    return rows.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys)


# Sinks ---------------------------------------------------------------------------------------
#: Buckets of a snapshot; a batch rewrites the buckets of the keys it changes.
BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose table of versions is complete, newest first."""
    store, where = _folder(spark, f"{path}/versions")
    if not store.exists(where):
        return []
    names = [status.getPath().getName() for status in store.listStatus(where)]
    whole = [n for n in names if n.startswith("batch=") and store.exists(_folder(spark, f"{path}/versions/{n}/_SUCCESS")[1])]
    return sorted((int(n.removeprefix("batch=")) for n in whole), reverse=True)


def _versions(spark: SparkSession, path: str, batch: int | None) -> dict[int, int]:
    """The batch that wrote each bucket last: one row per bucket."""
    if batch is None:
        return {}
    return {r.bucket: r.written for r in spark.read.schema("bucket int, written long").parquet(f"{path}/versions/batch={batch}").collect()}


def _bucket_paths(path: str, versions: dict[int, int]) -> list[str]:
    return [f"{path}/rows/batch={written}/bucket={bucket}" for bucket, written in sorted(versions.items())]


def fold_batch(changed: DataFrame, number: int, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Put the rows of a batch in place of the rows with their keys in the snapshot below ``path``.

    Keys are hashed to buckets; only buckets with changes are written, under the number of the
    batch, and a small table of versions names the batch that wrote each bucket last. It starts
    from the versions before this batch, so a batch that runs again replaces itself. The
    state before a batch is kept until the next one is complete, older folders go.
    """
    spark = changed.sparkSession
    rows = changed.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # Written first: a second look at the batch would run the stream's aggregation again.
    staged = f"{path}/changes/batch={number}"
    rows.write.mode("overwrite").parquet(staged)
    fresh = spark.read.schema(rows.schema).parquet(staged)
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
    if not touched:
        return
    done = [n for n in _committed(spark, path) if n < number]
    before = _versions(spark, path, done[0] if done else None)
    old = _bucket_paths(path, {b: before[b] for b in touched if b in before})
    merged = fresh
    if old:
        held = spark.read.schema(changed.schema).option("basePath", f"{path}/rows").parquet(*old).select(*changed.columns, "bucket")
        same = held["bucket"] == fresh["bucket"]
        for key in keys:
            same = same & held[key].eqNullSafe(fresh[key])
        merged = fresh.select(*changed.columns, "bucket").unionByName(held.join(fresh, same, "left_anti"))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")
    versions = before | dict.fromkeys(touched, number)
    table = spark.createDataFrame([(b, n) for b, n in versions.items()], "bucket int, written long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/batch={number}")
    _forget(spark, path, done, before)


def _forget(spark: SparkSession, path: str, done: list[int], before: dict[int, int]) -> None:
    """Delete what neither the newest state nor the one before it refers to."""
    for number in done[1:]:
        gone = [(b, n) for b, n in _versions(spark, path, number).items() if before.get(b) != n]
        for folder in [*_bucket_paths(path, dict(gone)), f"{path}/changes/batch={number}", f"{path}/versions/batch={number}"]:
            store, where = _folder(spark, folder)
            store.delete(where, True)


def run_updates(stream: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> list[dict]:
    """Drain a stream in update mode into a snapshot with one row per key; see fold_batch().
    Gives the progress of its batches."""

    def write(batch: DataFrame, number: int) -> None:
        fold_batch(batch, number, path, keys, buckets)

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return progress(query)


def run_append(stream: DataFrame, path: str) -> list[dict]:
    """Drain a stream in append mode into Parquet files; gives the progress of its batches."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return progress(query)


def progress(query) -> list[dict]:
    """Per batch: rows read, rows of state after it, and rows dropped as late."""
    out = []
    for p in query.recentProgress:
        state = p["stateOperators"]
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "state": sum(s["numRowsTotal"] for s in state), "late": sum(s["numRowsDroppedByWatermark"] for s in state)})
    return out


def latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest row per key: reads one snapshot, however many batches there were."""
    done = _committed(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    paths = _bucket_paths(path, _versions(spark, path, done[0]))
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*paths).drop("batch", "bucket")
