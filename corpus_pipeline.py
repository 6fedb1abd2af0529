"""The corpus pipeline: five stages over the table of documents, each written before the next."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from worktrail.llm.bpe import Tokens, encode  # noqa: E402
from worktrail.llm.decontam import without_items  # noqa: E402
from worktrail.llm.lines import line_dedup  # noqa: E402
from worktrail.llm.quality_trees import judge, learn  # noqa: E402
from worktrail.llm.simhash import one_per_group  # noqa: E402
from worktrail.session import pinned, prepare  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits or the trees reject go."""
    prepare(spark)
    trees = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, trees).filter("kept").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go from the texts; a document of which
    nothing is left goes too. ``n_chars`` follows the text."""
    prepare(spark)
    cut = line_dedup(docs).filter("lines_cut = 0 OR text RLIKE '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]'")
    length = F.when(F.col("lines_cut") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    prepare(spark)
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the given table of items go."""
    prepare(spark)
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    prepare(spark)
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, sink=Tokens)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_pairs),
]

#: Trained trees, fingerprints and byte pairs have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = pinned(docs)
    return docs
