"""Input tables the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.operators import mining as M
from worktrail.operators import profile as P
from worktrail.session import pinned, spread
from worktrail.sources import bridge
from worktrail.sources.raw_events import canonical_events, light_events


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.from_table(read(spark, sf_dir, "events"))


def fresh_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return light_events(raw(spark, sf_dir))


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that is written once per session and input, and read back by later steps."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = pinned(make())
    return _STAGED[key]


def light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light event table: profiles, windows and rule mining all read it, and none of
    them parses raw records again."""
    return staged(spark, sf_dir, "light", lambda: fresh_light(spark, sf_dir))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "profile", lambda: P.quality_profile(light(spark, sf_dir)))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "windows", lambda: P.anchored_windows(light(spark, sf_dir)))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "candidates", lambda: M.mine_candidates(light(spark, sf_dir)))


def canonical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return canonical_events(raw(spark, sf_dir), bridge.project_of(F.col("repo.name")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
