"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

Trees are trained in numpy on histograms of a bounded sample of labelled rows, with
monotonic constraints on the shares that only ever speak against a text, and flattened into
node arrays; every document is scored by walking all its rows down those arrays at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.llm.docstats import COUNTS, FEATURES, counts_and_features
from worktrail.llm.words import plus, settle, slices

#: Labelled rows to learn from at most, the smallest by hash of their key.
TRAIN_ROWS = 20_000
ROUNDS, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 4, 0.2, 64, 10, 1.0
#: The score may only fall as these grow.
FALLING = ["symbol_share", "dup_line_share", "repeat_share", "bang_share", "upper_share", "echo_share"]
LEAST_WORDS, MOST_REPEATED = 50, 50
KEEP_FROM = 0.5


@dataclass
class Trees:
    """Nodes of all trees in flat arrays. A leaf points to itself; ``roots`` starts each tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.bias)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _best_split(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, falling: np.ndarray, low: float, high: float):
    """Best (gain, feature, bin) of a node from its histograms (feature x bin)."""
    g, h, n = (np.cumsum(a, axis=1)[:, :-1] for a in (grad, hess, count))
    gs, hs, ns = grad.sum(axis=1)[:, None] - g, hess.sum(axis=1)[:, None] - h, count.sum(axis=1)[:, None] - n
    left, right = np.clip(-g / (h + RIDGE), low, high), np.clip(-gs / (hs + RIDGE), low, high)

    def worth(g, h, v):
        return -(g * v + 0.5 * (h + RIDGE) * v * v)

    all_g, all_h = grad[0].sum(), hess[0].sum()
    own = np.clip(-all_g / (all_h + RIDGE), low, high)
    gain = worth(g, h, left) + worth(gs, hs, right) - worth(all_g, all_h, own)
    gain[(n < LEAST_ROWS) | (ns < LEAST_ROWS) | (falling[:, None] & (left < right))] = -np.inf
    best = np.unravel_index(np.argmax(gain), gain.shape)
    return gain[best], int(best[0]), int(best[1]), float(left[best]), float(right[best])


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost trees of logistic loss. One label only, or no rows: a constant."""
    n, wide = x.shape if x.size else (0, len(FEATURES))
    share = (y.sum() + 0.5) / (n + 1) if n else 1.0
    bias = float(np.log(share / (1 - share))) if 0 < share < 1 else 40.0
    nodes: list[list] = []  # feature, cut, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(wide)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(wide)], axis=1)
        falling = np.array([f in FALLING for f in FEATURES])
        total = np.full(n, bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(nodes))
            work = [(np.arange(n), 0, -np.inf, np.inf, np.clip(-grad.sum() / (hess.sum() + RIDGE), -4, 4))]
            nodes.append([0, 0.0, roots[-1], roots[-1], 0.0])
            places = [roots[-1]]
            while work:
                rows, depth, low, high, value = work.pop()
                at = places.pop()
                split = None
                if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
                    key = binned[rows] + np.arange(wide) * BINS
                    hist = [np.bincount(key.ravel(), np.repeat(w, wide), wide * BINS).reshape(wide, BINS) for w in (grad[rows], hess[rows], np.ones(len(rows)))]
                    split = _best_split(*hist, falling, max(low, -4), min(high, 4))
                if split is None or not split[0] > 1e-6:
                    nodes[at][4] = RATE * float(value)
                    total[rows] += nodes[at][4]
                    continue
                _, f, b, left, right = split
                goes = binned[rows, f] <= b
                nodes[at] = [f, float(edges[f][b]), len(nodes), len(nodes) + 1, 0.0]
                middle = (left + right) / 2
                bounds = ((middle, high), (low, middle)) if falling[f] else ((low, high), (low, high))
                for child, v, (lo, hi) in zip((rows[goes], rows[~goes]), (left, right), bounds, strict=True):
                    places.append(len(nodes))
                    nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
                    work.append((child, depth + 1, lo, hi, v))
    columns = list(zip(*nodes, strict=True)) if nodes else [()] * 5
    return Trees(*(np.array(c, dtype=k) for c, k in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True)), np.array(roots, dtype=np.int64), bias, DEPTH)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def _with_features(docs: DataFrame, text: str, rest: list[str]) -> DataFrame:
    settle(docs.sparkSession)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, text):
                x = pa.array(list(counts_and_features(words)[1]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), x], names=[*rest, "x"])

    return docs.select(*rest, text).mapInArrow(tasks, plus(docs.select(*rest).schema, "x array<double>"))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents: the labels with the smallest hash of
    their key, whatever the size of the tables. Labels with a null are ignored."""
    chosen = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).dropna().distinct()
    sample = chosen.orderBy(F.xxhash64("key"), "key", "y").limit(rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # At most `rows` pairs of numbers: a bounded side.
    found = _with_features(texts.join(F.broadcast(sample), "key").select("key", "y", "text"), "text", ["key", "y"])
    # Repeated keys in the documents could lift the bound, so it holds here again.
    got = found.orderBy(F.xxhash64("key"), "key", "y", "x").limit(rows).toPandas()
    if got.empty:
        return train(np.empty((0, len(FEATURES))), np.empty(0))
    return train(np.stack(got["x"].to_numpy()).astype(float), got["y"].to_numpy().astype(float))


def judge(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with COUNTS (long), ``base_failed``, ``score`` and ``kept``; columns
    so named before are replaced.

    Null texts count as empty: zero counts and a failed base. A text fails the base with fewer
    than 50 words, or if over half its words lie in repeated windows of three.
    """
    settle(docs.sparkSession)
    added = [*COUNTS, "base_failed", "score", "kept"]
    rest = [c for c in docs.columns if c not in added]
    shape = plus(docs.select(*rest).schema, ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, text):
                counts, x = counts_and_features(words)
                failed, score = base_failed(counts), trees.score(x)
                new = [*(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP_FROM))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*rest, *added])

    return docs.select(*rest).mapInArrow(tasks, shape)
