"""Document scores by masked pseudo-likelihood.

A small network predicts every word from the two words on either side of it. Its words are
the commonest of the whole corpus; all others share buckets by hash. Training is data
parallel: each round every task runs through all its texts from the same weights, and the
weights of all tasks are averaged in a tree. A document's score is the sum of the log
probabilities of its words, each given its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.llm.words import LOWER, gathered, plus, settle, slices
from worktrail.session import pinned

#: Words predicted: GROUPS * GROUPS ids, of which BUCKETS stand for all rarer words.
GROUPS, BUCKETS = 32, 24
WORDS = GROUPS * GROUPS
HIDDEN, ROUNDS, BATCH, RATE, SEED = 16, 2, 2048, 0.8, 5
#: Places around a word that it is predicted from.
AROUND = (-2, -1, 1, 2)
#: Weight blobs that one task of the averaging tree adds up.
FAN = 16


@dataclass
class Net:
    """Weights: an embedding per place around, a hidden layer, and a softmax in two steps: over
    groups of words, then over the words of a group from a hidden layer that the group lifts."""

    embed: np.ndarray  # place x (WORDS + 1) x HIDDEN; the last word is the edge of a text
    bias: np.ndarray
    group: np.ndarray  # HIDDEN x GROUPS
    group_bias: np.ndarray
    lift: np.ndarray  # GROUPS x HIDDEN
    word: np.ndarray  # HIDDEN x GROUPS
    word_bias: np.ndarray  # GROUPS x GROUPS

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Net:
        """Small random weights; the biases are the unigram model of the corpus."""
        rng = np.random.default_rng(SEED)
        small = lambda *shape: (rng.normal(0, 0.1, shape)).astype(np.float32)
        share = (counts + 1.0).reshape(GROUPS, GROUPS)
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True)).astype(np.float32)
        zero = np.zeros(HIDDEN, dtype=np.float32)
        return cls(small(len(AROUND), WORDS + 1, HIDDEN), zero, small(HIDDEN, GROUPS), log(share.sum(axis=1)), small(GROUPS, HIDDEN), small(HIDDEN, GROUPS), log(share))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def of(self, flat: np.ndarray) -> Net:
        out, at = [], 0
        for f in fields(self):
            shape = getattr(self, f.name).shape
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return Net(*out)

    def _hidden(self, which: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layers that choose the group, and the word of the given groups."""
        total = np.take(self.embed[0], around[0], axis=0, mode="clip")
        for k in range(1, len(AROUND)):
            total += np.take(self.embed[k], around[k], axis=0, mode="clip")
        total += self.bias
        return _squash(total), _squash(total + np.take(self.lift, which, axis=0, mode="clip"))

    def log_probs(self, target: np.ndarray, around: np.ndarray) -> np.ndarray:
        """log P(target | around) for each place."""
        which, rows = target // GROUPS, np.arange(len(target))
        first, second = self._hidden(which, around)
        groups, words = first @ self.group + self.group_bias, second @ self.word + self.word_bias[which]
        return groups[rows, which] - _log_sum(groups) + words[rows, target % GROUPS] - _log_sum(words)

    def gradient(self, target: np.ndarray, around: np.ndarray) -> Net:
        """Gradient of the mean negative log probability of a batch."""
        which, rows = target // GROUPS, np.arange(len(target))
        first, second = self._hidden(which, around)
        errors = []
        for logits, right in ((first @ self.group + self.group_bias, which), (second @ self.word + self.word_bias[which], target % GROUPS)):
            e = _softmax(logits)
            e[rows, right] -= 1
            e /= np.float32(len(target))
            errors.append(e)
        lifted = (errors[1] @ self.word.T) * _slope(second)
        down = (errors[0] @ self.group.T) * _slope(first) + lifted
        embed = np.stack([_sums(around[k], down, WORDS + 1) for k in range(len(AROUND))])
        chosen = np.zeros((GROUPS, len(target)), dtype=np.float32)
        chosen[which, rows] = 1
        return Net(embed, down.sum(axis=0), first.T @ errors[0], errors[0].sum(axis=0), chosen @ lifted, second.T @ errors[1], chosen @ errors[1])


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """Derivative of the squash where its value is y."""
    left = 1 - np.abs(y)
    return left * left


def _sums(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each id."""
    wide = rows.shape[1]
    cells = (ids.astype(np.int64)[:, None] * wide + np.arange(wide)).ravel()
    return np.bincount(cells, rows.ravel(), size * wide).reshape(size, wide).astype(rows.dtype)


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """exp(logits - top), its row sums, and top. Logits of a small net lie within a few units
    of each other, so one top for all rows is enough; sums are kept above zero."""
    top = float(logits.max(initial=0))
    e = np.exp(logits - np.float32(top))
    return e, np.maximum(e @ np.ones(e.shape[1], dtype=e.dtype), np.float32(1e-30)), top


def _log_sum(logits: np.ndarray) -> np.ndarray:
    _, total, top = _exp(logits)
    return np.log(total) + top


def _softmax(logits: np.ndarray) -> np.ndarray:
    e, total, _ = _exp(logits)
    e /= total[:, None]
    return e


def _windows(tokens: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, around, text of each place) of texts as arrays of 16-bit ids."""
    parts = [np.frombuffer(t, dtype=np.int16) for t in tokens.to_pylist()]
    n = np.array([len(p) for p in parts], dtype=np.int64)
    ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.int16)
    owner = np.repeat(np.arange(len(parts)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(ids))
    around = np.full((len(AROUND), len(ids)), WORDS, dtype=np.int16)
    for k, step in enumerate(AROUND):
        at = place + step
        inside = (at >= first[owner]) & (at < first[owner] + n[owner])
        around[k, inside] = ids[at[inside]]
    return ids, around, owner


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some texts whose ids take a megabyte, or of one longer text."""
    for table in gathered(batches, 256):
        sizes = np.cumsum([len(x) for x in table.column("tokens").to_pylist()])
        at = 0
        while at < table.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + (1 << 20), side="right")))
            yield table.slice(at, to - at)
            at = to


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(h, n): how often each word of the corpus occurs, by hash."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in slices(batch, text):
                h, n = np.unique(words.hashes(LOWER[words.data]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return pinned(docs.select(text).mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, text: str, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the commonest words, their ids, counts per id) over all documents."""
    counts = word_counts(docs, text) if counts is None else counts
    kept = WORDS - BUCKETS
    top = counts.orderBy(F.desc("n"), "h").limit(kept)
    rows = [(r.h, r.n) for r in top.collect()]  # at most `kept` rows
    rare = counts.join(F.broadcast(top.select("h")), "h", "left_anti").groupBy(F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.sum("n").alias("n")).collect()
    hashes = np.array([h for h, _ in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    total = np.zeros(WORDS)
    total[: len(rows)] = [n for _, n in rows]
    for r in rare:
        total[kept + r.b] = r.n
    return hashes[order], np.arange(len(rows), dtype=np.int16)[order], total


def tokens(docs: DataFrame, known: np.ndarray, ids: np.ndarray, key: str, text: str, rare: bool = False) -> DataFrame:
    """(key, tokens): 16-bit word ids of each whole text, as bytes; if ``rare``, also the
    distinct words without an id of their own (rare) and how often each stands there (times)."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch):
                h = words.hashes(LOWER[words.data])
                other = np.ones(len(h), dtype=bool)
                out = (WORDS - BUCKETS + (h.view(np.int64) % BUCKETS)).astype(np.int16)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                    out[hit] = ids[at[hit]]
                    other = ~hit
                raw = [out[s:e].tobytes() for s, e in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                columns, names = [part.column(0), pa.array(raw, pa.binary())], ["key", "tokens"]
                if rare:
                    own = [np.unique(h[s:e][other[s:e]].view(np.int64), return_counts=True) for s, e in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                    columns += [pa.array([u for u, _ in own], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in own], pa.list_(pa.int32()))]
                    names += ["rare", "times"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tasks, plus(rows.select("key").schema, "tokens binary" + (", rare array<long>, times array<int>" if rare else "")))


def rare_log_probs(table: DataFrame, counts: DataFrame, totals: np.ndarray) -> DataFrame:
    """(row, more): per row the sum of log P(word | its bucket) over its rare words."""
    logs = F.array(*[F.lit(float(np.log(max(n, 1.0)))) for n in totals[WORDS - BUCKETS :]])
    each = counts.select("h", (F.log("n") - F.get(logs, F.pmod("h", F.lit(BUCKETS)).cast("int"))).alias("p"))
    rows = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    return rows.join(each, "h").groupBy("row").agg(F.sum(F.col("times") * F.col("p")).alias("more"))


def _averaged(blobs: DataFrame, parts: int) -> np.ndarray | None:
    """Weighted mean of weight blobs (part, n, w), FAN at a time until a few are left."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for p, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = held.setdefault(p // FAN, [0.0, 0.0])
                now[0] += n
                now[1] = now[1] + np.frombuffer(w)
        rows = sorted(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([float(v[0]) for _, v in rows], pa.float64()), pa.array([v[1].tobytes() for _, v in rows], pa.binary())], names=["part", "n", "w"])

    while parts > FAN:
        parts = -(-parts // FAN)
        blobs = blobs.withColumn("to", F.expr(f"part div {FAN}")).repartition(parts, "to").drop("to").sortWithinPartitions("part").mapInArrow(added, "part int, n double, w binary")
    rows = sorted(blobs.collect(), key=lambda r: r.part)  # FAN blobs of fixed size at most
    total = sum(r.n for r in rows)
    return sum(np.frombuffer(bytes(r.w)) for r in rows) / total if total else None


def train(table: DataFrame, counts: np.ndarray) -> Net:
    """Weights after ROUNDS passes over all texts (key, tokens)."""
    net = Net.fresh(counts)
    spark = table.sparkSession
    parts = table.rdd.getNumPartitions()
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(net)

        def tasks(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            net, part, seen = shared.value, 0, 0
            flat = net.flat()
            net = net.of(flat)
            squares = [np.full(getattr(net, f.name).shape, 1e-3, dtype=np.float32) for f in fields(net)]
            for portion in _portions(batches):
                part = portion.column("part")[0].as_py()
                ids, around, _ = _windows(portion.column("tokens"))
                order = np.random.default_rng([SEED, turn, part, seen]).permutation(len(ids))
                for at in range(0, len(ids), BATCH):
                    rows = order[at : at + BATCH]
                    step = net.gradient(ids[rows], around[:, rows])
                    for f, square in zip(fields(net), squares, strict=True):
                        g, w = getattr(step, f.name), getattr(net, f.name)
                        square += g * g
                        w -= RATE / (turn + 1) * g / np.sqrt(square)
                seen += len(ids)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(seen)]), pa.array([(net.flat().astype(np.float64) * seen).tobytes()], pa.binary())], names=["part", "n", "w"])

        numbered = table.select("tokens", F.spark_partition_id().alias("part"))
        mean = _averaged(numbered.mapInArrow(tasks, "part int, n double, w binary"), parts)
        net = net if mean is None else net.of(mean)
    return net


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", every_word: bool = False) -> DataFrame:
    """Per row of ``docs``: key, ``n_tokens``, ``log_prob`` (sum over its words) and
    ``mean_log_prob`` (0 for texts without words).

    Words are compared in any ASCII case. Null texts have no words; repeated rows train and
    score as rows each. Only key and text are read. An empty table gives an empty result.
    With ``every_word``, a rare word's probability is its bucket's times its share of the
    bucket in the corpus; without it, all words of a bucket count as one.
    """
    settle(docs.sparkSession)
    counted = word_counts(docs, text)
    known, ids, counts = vocabulary(docs, text, counted)
    table = tokens(docs, known, ids, key, text, every_word)
    # Rows are numbered once and written, so that a row keeps its number.
    table = pinned(table.withColumn("row", F.monotonically_increasing_id()) if every_word else table)
    net = train(table, counts)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _portions(batches):
            ids, around, owner = _windows(portion.column("tokens"))
            total = np.zeros(portion.num_rows)
            for at in range(0, len(ids), 1 << 15):
                some = slice(at, at + (1 << 15))
                total += np.bincount(owner[some], shared.value.log_probs(ids[some], around[:, some]), portion.num_rows)
            n = np.bincount(owner, minlength=portion.num_rows)
            columns = [*(portion.column(c).combine_chunks() for c in named), pa.array(n, pa.int64()), pa.array(total), pa.array(total / np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*named, "n_tokens", "log_prob", "mean_log_prob"])

    named = ["key", "row"] if every_word else ["key"]
    shape = plus(table.select(*named).schema, "n_tokens long, log_prob double, mean_log_prob double")
    out = table.select(*named, "tokens").mapInArrow(tasks, shape)
    if every_word:
        both = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
        out = out.join(rare_log_probs(table, counted, counts), "row", "left").select("key", "n_tokens", both.alias("log_prob"), (both / F.greatest("n_tokens", F.lit(1))).alias("mean_log_prob"))
    return out.withColumnRenamed("key", key)
