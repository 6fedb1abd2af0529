"""Session defaults and the two ways in which a plan's lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "worktrail") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.worktrail.spread", cores)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="worktrail-checkpoint-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/worktrail-{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, so a
    lost executor re-reads files and sampled range bounds are never drawn again. Written
    tables also keep their size for join choices, and columns for pruning."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Runtime settings the operators count on. A join with a hot key is split even where
    the following grouping then needs one more shuffle."""
    for name in ("enabled", "skewJoin.enabled", "coalescePartitions.enabled", "forceOptimizeSkewedJoin"):
        spark.conf.set(f"spark.sql.adaptive.{name}", "true")


#: Bytes that a row takes in memory for each byte in a written table, where Spark estimates the
#: table from its files: columns of few values shrink to a thirtieth and less.
ROW_BYTES = 32


def prepare_tables(spark: SparkSession) -> None:
    """As prepare, for queries over written tables. Without the factor a join takes a file of a
    few compressed megabytes for a small table and sends its rows, thirty times the size and more,
    through the driver to all executors; what is small when it has been read still goes that way."""
    prepare(spark)
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < ROW_BYTES:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(ROW_BYTES))


#: Tasks per core that a table with few splits is dealt out to.
TASKS_PER_CORE = 4


def tasks_wanted(spark: SparkSession) -> int:
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out to as many partitions as the session asks for in spark.worktrail.spread.
    Without that setting a table of few splits is dealt out to four tasks a core: a file of few
    row groups would leave all row-wise work to as many tasks, whatever the cluster has. Tables
    of more splits keep them, so what is dealt out is bounded by the size of that many splits."""
    parts = df.sparkSession.conf.get("spark.worktrail.spread", None)
    if parts:
        return df.repartition(int(parts))
    wanted = tasks_wanted(df.sparkSession)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
