"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Cosines of random projections approximate a Gaussian kernel over document statistics. Each
task sums the normal equations of its labelled rows, Spark adds the sums, and the driver
solves one small system. Calibration pools adjacent violators over bins of the raw score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.llm.docstats import FEATURES, counts_and_features
from worktrail.llm.words import gathered, plus, settle, slices
from worktrail.session import pinned

#: Size of the model: random features, kernel width in standard deviations, ridge, score bins.
COSINES, WIDTH, RIDGE, SCORE_BINS, SEED = 192, 4.0, 1e-3, 512, 17


@dataclass
class Kernel:
    """Standardised statistics -> cosines -> weights -> calibrated probability."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    steps_at: np.ndarray
    steps: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        turns = rng.normal(0, 1 / WIDTH, (x.shape[1], COSINES))
        shifts = rng.uniform(0, 2 * np.pi, COSINES)
        z = np.sqrt(2 / COSINES) * np.cos(np.clip((x - self.mean) / self.spread, -8, 8) @ turns + shifts)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps_at, self.steps)


def held_out(key: Column) -> Column:
    """Rows that only measure: the checksum of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _calibration(key: Column) -> Column:
    """A third of the learning rows calibrates; the others fit the weights."""
    return F.pmod(F.xxhash64(key), F.lit(3)) == 0


def statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x): FEATURES of every row's whole text."""
    settle(docs.sparkSession)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch):
                x = pa.array(list(counts_and_features(words)[1]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), x], names=["key", "x"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tasks, plus(rows.select("key").schema, "x array<double>"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def pool_adjacent(score: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means over scores in ascending order, one point per pool."""
    pools: list[list[float]] = []
    for s, h, n in zip(score.tolist(), hits.tolist(), rows.tolist(), strict=True):
        pools.append([s * n, h, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(rows: DataFrame) -> Kernel:
    """A model from labelled statistics (key, x, y). Without rows, or with one label only, it
    is a constant: the share of label 1 with one half added to either side."""
    wide = len(FEATURES)
    train = rows.filter(~_calibration(F.col("key")))
    moments = train.agg(
        F.count("*").alias("n"), F.sum("y").alias("hits"),
        *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(wide)], *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(wide)],
    ).first()
    n, hits = moments["n"], moments["hits"] or 0
    if not 0 < hits < n:
        share = (hits + 0.5) / (n + 1)
        return Kernel(np.zeros(wide), np.ones(wide), np.zeros(COSINES + 1), np.array([0.0]), np.array([share]))
    mean, spread = (np.array([moments[f"{c}{i}"] for i in range(wide)]) for c in "ms")
    model = Kernel(mean, np.maximum(spread, 1e-6), np.zeros(COSINES + 1), np.zeros(1), np.zeros(1))
    size = COSINES + 1
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for part in gathered(batches, 1 << 13):
            z, y = model.features(_matrix(part.column("x"))), part.column("y").to_numpy()
            left += z.T @ z
            right += z.T @ y
        if right[-1] or left[-1, -1]:
            i, j = np.concatenate([upper[0], np.full(size, -1)]), np.concatenate([upper[1], np.arange(size)])
            v = np.concatenate([left[upper], right])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], names=["i", "j", "v"])

    # The system is as large as the model, whatever the number of rows.
    total = train.select("x", F.col("y").cast("double").alias("y")).mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    left, right = np.zeros((size, size)), np.zeros(size)
    i, j, v = (total[c].to_numpy() for c in "ijv")
    right[j[i < 0]] = v[i < 0]
    left[i[i >= 0], j[i >= 0]] = v[i >= 0]
    left = left + np.triu(left, 1).T
    model.weights = np.linalg.solve(left + RIDGE * n * np.eye(size) / COSINES, right)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, 1 << 13):
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(part.column("x")))), part.column("y").combine_chunks()], names=["r", "y"])

    binned = rows.filter(_calibration(F.col("key"))).select("x", F.col("y").cast("double").alias("y")).mapInArrow(raw, "r double, y double")
    place = F.floor(F.least(F.greatest("r", F.lit(-0.5)), F.lit(1.5)) * (SCORE_BINS / 2))
    pools = binned.groupBy(place.alias("b")).agg(F.avg("r").alias("r"), F.sum("y").alias("h"), F.count("*").alias("n")).orderBy("b").toPandas()
    if pools.empty:
        model.steps_at, model.steps = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        model.steps_at, model.steps = pool_adjacent(*(pools[c].to_numpy() for c in "rhn"))
    return model


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Per row of ``docs``: key, ``held_out``, ``score`` (0 to 1) and ``predicted`` (0 or 1).

    All labelled rows that aren't held out are learned from; labels with a null key or value
    are ignored, repeated labels count once. Null texts score as empty ones; a null key is
    never held out. Only key and text of ``docs`` are read. No labels: a constant score.
    """
    rows = pinned(statistics(docs, key, text))
    y = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).dropna().distinct()
    model = fit(pinned(rows.join(y.filter(~held_out(F.col("key"))), "key")))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, 1 << 13):
            score = model.score(_matrix(part.column("x")))
            yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks(), pa.array(np.clip(score, 0, 1))], names=["key", "score"])

    scored = rows.mapInArrow(tasks, plus(rows.select("key").schema, "score double"))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", predicted.alias("predicted"))
