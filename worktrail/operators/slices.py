"""Deterministic slices of raw records under caps, and their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.operators.ordering import group_positions, top_rows
from worktrail.sources.raw_events import LIGHT_TYPES


def slice_events(
    raw: DataFrame, repos: list[str] | None = None, max_records: int | None = None, max_records_per_repo: int | None = None,
    max_records_per_file: int | None = None,
) -> DataFrame:
    """Accepted records in file and row order under up to three caps: first per repository,
    then per file, then overall. Records without a repository pass the repository cap."""
    kept = raw.filter(F.col("type").isin(LIGHT_TYPES))
    if repos:
        kept = kept.filter(F.col("repo.name").isin(repos))
    order = [F.col("source_file"), F.col("ord")]
    if max_records_per_repo is not None:
        named = kept.withColumn("repo_name", F.nullif(F.col("repo.name"), F.lit("")))
        capped = top_rows(named.filter("repo_name is not null"), ["repo_name"], order, max_records_per_repo, "rn").drop("rn")
        kept = capped.unionByName(named.filter("repo_name is null")).drop("repo_name")
    if max_records_per_file is not None:
        kept = top_rows(kept, ["source_file"], order, max_records_per_file, "rn").drop("rn")
    if max_records is not None:
        placed = group_positions(kept.withColumn("all", F.lit(0)), ["all"], ["source_file", "ord"])
        kept = placed.filter(F.col("pos") < max_records).drop("all", "pos", "group_rows")
    return kept


def slice_manifest(sliced: DataFrame) -> DataFrame:
    """Selected records by repository and by raw type."""
    by_repo = sliced.filter("repo.name is not null").groupBy(F.col("repo.name").alias("value")).agg(F.count("*").alias("n"))
    by_type = sliced.groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n"))
    return by_repo.withColumn("dimension", F.lit("repo")).unionByName(by_type.withColumn("dimension", F.lit("type")))
