"""Predictors that users bring as a Python function."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.operators.ordering import group_positions
from worktrail.session import pinned

PREDICTION_SCHEMA = "prediction_id string, project_id string, probe_id string, prediction string, retrieved_event_ids array<string>"
EVENT_COLUMNS = ["event_id", "timestamp", "actor", "event_type", "content"]
Predictor = Callable[[pd.DataFrame, Iterator[pd.DataFrame]], Iterable[tuple[str, str, list[str]]]]


def apply_predictor(predict: Predictor, events: DataFrame, probes: DataFrame, block: int = 1000) -> DataFrame:
    """Call ``predict`` with questions of a project (probe_id, query) and a stream of batches of
    all the project's public events in file order; it yields (probe_id, text, event ids).

    A project's questions come in blocks of at most ``block``, in order of probe_id: each block is
    a call and a group of its own with the project's event stream, so the questions that a call
    holds are bounded, and a project with most of the questions spreads over tasks. Events stream
    from sorted partitions, so a project of any size passes a predictor that keeps what it needs
    only. An answer to a question that wasn't asked raises.
    """
    absent = F.lit(None).cast("string")
    numbered = group_positions(probes.select("project_id", "probe_id", "query"), ["project_id"], ["probe_id"]).withColumn("block", F.expr(f"pos div {block}"))
    numbered = pinned(numbered.select("project_id", "block", "probe_id", "query"))
    asked = numbered.select("project_id", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"), "probe_id", "query", *[absent.alias(c) for c in EVENT_COLUMNS])
    told = events.select("project_id", F.lit(1).alias("kind"), "ord", absent.alias("probe_id"), absent.alias("query"), *EVENT_COLUMNS)
    rows = asked.unionByName(told.join(numbered.select("project_id", "block").distinct(), "project_id"))
    ordered = rows.repartition("project_id", "block").sortWithinPartitions("project_id", "block", "kind", "ord", "probe_id")

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], int, pd.DataFrame]]:
        for frame in frames:
            for (project, number, kind), piece in frame.groupby(["project_id", "block", "kind"], sort=False):
                yield (project, number), kind, piece

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (project, _), parts in groupby(pieces(frames), key=lambda p: p[0]):
            questions, first = [], []
            for _, kind, piece in parts:
                if kind:
                    first = [piece]
                    break
                questions.append(piece[["probe_id", "query"]])
            asked = pd.concat(questions, ignore_index=True)
            stream = (piece[EVENT_COLUMNS] for piece in chain(first, (p for _, _, p in parts)))
            known = set(asked["probe_id"])
            out = []
            for probe, text, ids in predict(asked, stream):
                if probe not in known:
                    raise ValueError(f"a predictor answered {probe}, which project {project} doesn't ask")
                out.append((f"pred_{project}_{probe}", project, probe, text, list(ids)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PREDICTION_SCHEMA.split(", ")])

    return ordered.mapInPandas(call, PREDICTION_SCHEMA)


def read_submissions(spark, path: str) -> DataFrame:
    """Every submission of a folder; the system is named after its file or folder."""
    from worktrail.schemas import PREDICTION

    rows = spark.read.schema(PREDICTION).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
    stem = F.regexp_extract(F.url_decode("_metadata.file_path"), r"/([^/]+)\.jsonl(?:/[^/]*)?$", 1)
    named = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    rows = rows.withColumn("row_no", F.monotonically_increasing_id())
    return rows.withColumn("baseline", F.when(named == "", "submission").otherwise(named)).withColumn(
        "memory_ids", F.coalesce("retrieved_memory_ids", F.array().cast("array<string>"))
    )


def retrieved_events(submissions: DataFrame) -> DataFrame:
    """One row per event that a submitted row names."""
    return submissions.select("baseline", "row_no", "project_id", "probe_id", F.explode("retrieved_event_ids").alias("event_id"))
