"""Passages that repeat across documents, found by collinear chaining of shared k-mers.

Seeds are k-mers of words, thinned to window minimisers, so every verbatim run of at least
``K + WINDOW - 1`` words shares one. A repeated seed links each of its places to the first
place anywhere, never all places to each other; so do the longer runs that begin at it, whose
first place may be in another document. The links of two documents are put into
chains in order of both texts by dynamic programming with gap costs, its prefix maxima in a
Fenwick tree. Words are fetched for the chains only; gaps and ends are aligned, and stretches
where at least four of five aligned words agree are the passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.llm.words import LOWER, Words, gathered, mix, plus, settle, slices
from worktrail.session import pinned

K, WINDOW = 5, 10
#: Words of a passage at least, and how far beyond its outer seeds a chain is aligned. A
#: passage of 50 words with edits near its ends still has 40 between them.
LEAST_WORDS, REACH = 40, 64
#: A seed also stands for the runs of so many words that begin with it, each linked to its own
#: first place. Every verbatim passage of 49 words or more holds a whole run of the last size.
RUNS = (10, 20, 40)
#: Cost of a word that a chain skips in either text, in words gained.
GAP = 0.1
#: Score of an aligned pair of equal words and of an edit: 0.8 similarity breaks even.
SAME, EDIT = 1, -4

_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.array([1, 31, 961, 29791, 923521], dtype=np.int64)


def _lowered(words: Words) -> np.ndarray:
    return words.hashes(LOWER[words.data])


def minimisers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of first word, hash) of the seeds of a slice. A text of fewer k-mers than
    a window holds is one window."""
    at = words.windows(K)
    h = _lowered(words)
    if not len(at):
        return np.empty(0, dtype=np.int64), at, h[:0]
    grams = h[at]
    for k in range(1, K):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
    owner = words.owner()[at]
    n = np.bincount(owner, minlength=words.texts)
    # Texts stand WINDOW places apart, so that no window holds k-mers of two.
    place = np.arange(len(at)) + owner * WINDOW
    line = np.full(int(place[-1]) + 2 * WINDOW, _NEVER, dtype=np.uint64)
    line[place] = grams
    low = line.copy()
    span = 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    first = np.cumsum(n) - n
    left = n[owner] - (np.arange(len(at)) - first[owner])
    full = (left >= WINDOW) | (left == n[owner])
    begin = place[full]
    best = low[begin]
    chosen = np.zeros(len(line), dtype=bool)
    todo = np.arange(len(begin))
    for d in range(WINDOW):
        hit = line[begin[todo] + d] == best[todo]
        chosen[begin[todo[hit]] + d] = True
        todo = todo[~hit]
    kept = np.flatnonzero(chosen[place])
    # A seed that repeats the one before it in its text adds nothing.
    same = np.zeros(len(kept), dtype=bool)
    same[1:] = (grams[kept[1:]] == grams[kept[:-1]]) & (owner[kept[1:]] == owner[kept[:-1]])
    kept = kept[~same]
    return owner[kept], at[kept] - words.first[owner[kept]], grams[kept]


def runs(words: Words, owner: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per size of RUNS: 32-bit hash of the run that begins at each seed, and whether its text
    is long enough for it."""
    h = _lowered(words)
    at = words.first[owner] + place
    left = words.first[owner + 1] - at
    out = []
    for size in RUNS:
        whole = left >= size
        total = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            total[whole] = (total[whole] + h[at[whole] + k]) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((mix(total + np.uint64(size)) >> np.uint64(32)).astype(np.uint32).view(np.int32), whole))
    return out


class Fenwick:
    """Prefix maxima over ranks, each with the item that reached it."""

    def __init__(self, n: int):
        self.best, self.who = [-1e18] * (n + 1), [-1] * (n + 1)

    def put(self, rank: int, value: float, who: int) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank]:
                self.best[rank], self.who[rank] = value, who
            rank += rank & -rank

    def up_to(self, rank: int) -> tuple[float, int]:
        """The best among ranks below ``rank``."""
        value, who = -1e18, -1
        while rank > 0:
            if self.best[rank] > value:
                value, who = self.best[rank], self.who[rank]
            rank -= rank & -rank
        return value, who


def chains(at: np.ndarray, source: np.ndarray) -> list[list[int]]:
    """Best local chains of anchors (place, source place), each anchor in one at most.

    A chain rises in both texts. Skipped words cost GAP each, which splits over the two ends
    of a gap, so the best predecessor is a prefix maximum over source places.
    """
    order = np.lexsort((-source, at))
    rank = np.unique(source, return_inverse=True)[1]
    tree = Fenwick(len(at))
    score, before = [0.0] * len(at), [-1] * len(at)
    waiting: list[int] = []
    for i in order.tolist():
        if waiting and at[waiting[0]] != at[i]:
            for j in waiting:
                tree.put(int(rank[j]), score[j] + GAP * (int(at[j]) + int(source[j])), j)
            waiting = []
        value, j = tree.up_to(int(rank[i]))
        gain = value - GAP * (int(at[i]) + int(source[i]))
        score[i], before[i] = (K + gain, j) if j >= 0 and gain > 0 else (float(K), -1)
        waiting.append(i)
    used, out = [False] * len(at), []
    for i in sorted(range(len(at)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best score of aligning every two beginnings of two stretches."""
    n, m = len(a), len(b)
    table = np.zeros((n + 1, m + 1), dtype=np.int32)
    place = np.arange(m + 1, dtype=np.int32) * EDIT
    table[0] = place
    for i in range(1, n + 1):
        new = np.empty(m + 1, dtype=np.int32)
        new[0] = table[i - 1, 0] + EDIT
        new[1:] = np.maximum(table[i - 1, 1:] + EDIT, table[i - 1, :-1] + np.where(b == a[i - 1], SAME, EDIT))
        table[i] = np.maximum.accumulate(new - place) + place
    return table


def _matches(a: np.ndarray, b: np.ndarray, table: np.ndarray | None = None, spare: int = 0) -> np.ndarray:
    """Aligned pairs (i, j), -1 for a gap, of two stretches that begin together. They end
    together too, or, with a table, at the farthest place whose score is -spare or more."""
    if table is None:
        table = _table(a, b)
        i, j = len(a), len(b)
    else:
        far = np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
        far[table < -spare] = -1
        top = np.argwhere(far == far.max())
        i, j = (int(x) for x in top[np.argmax(table[top[:, 0], top[:, 1]])])
    rows, a, b = table.tolist(), a.tolist(), b.tolist()
    out = []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (SAME if a[i - 1] == b[j - 1] else EDIT):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and rows[i][j] == rows[i - 1][j] + EDIT:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return np.array(out[::-1], dtype=np.int64).reshape(-1, 2)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two stretches share as many runs of three words as a passage must (never false
    if they hold one): of n columns with e edits, n - 3 e - 2 begin three equal ones."""
    if min(len(a), len(b)) < LEAST_WORDS * 4 // 5:
        return False
    p, q = (sum(int(_ODD[k]) * x[k : len(x) - 2 + k].astype(np.int64) for k in range(3)) for x in (a, b))
    return int(np.isin(p, q).sum()) >= LEAST_WORDS - 3 * (LEAST_WORDS // (1 - EDIT)) - 2


class _Side:
    """What follows a common beginning: equal words first, then up to REACH words aligned."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        self.run = int(differ[0]) if len(differ) else n
        self.rest = tuple(x[self.run : self.run + REACH] for x in (a, b))
        self.table = _table(*self.rest)
        self.best = SAME * self.run + int(self.table.max())

    def pairs(self, spare: int) -> np.ndarray:
        """Alignment to the farthest place that ``spare`` and its own words still pay for."""
        rest = _matches(*self.rest, self.table, spare + SAME * self.run)
        return np.concatenate([np.stack([np.arange(self.run)] * 2, axis=1), np.where(rest >= 0, rest + self.run, -1)])


def _gains(a: np.ndarray, b: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    same = (pairs >= 0).all(axis=1)
    same[same] = a[pairs[same, 0]] == b[pairs[same, 1]]
    return np.where(same, SAME, EDIT)


def align(a: np.ndarray, b: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Alignment (pairs of places, -1 for a gap) of two stretches through a chain of anchors:
    k-mers that both share. Stretches of one diagonal go word by word unless they differ much."""
    i, j = (int(x) for x in anchors[0])
    first, back = np.array([i - 1, j - 1]), _Side(a[:i][::-1], b[:j][::-1])
    out: list[np.ndarray] = []

    def straight(x: int, y: int, n: int) -> None:
        out.append(np.stack([np.arange(x, x + n), np.arange(y, y + n)], axis=1))

    diagonal = anchors[:, 0] - anchors[:, 1]
    begins = np.flatnonzero(np.append(True, diagonal[1:] != diagonal[:-1]))
    for s, e in zip(begins.tolist(), [*begins[1:].tolist(), len(anchors)], strict=True):
        x, y = (int(v) for v in anchors[s])
        late = max(i - x, j - y, 0)  # it overlaps the diagonal before
        x, y = x + late, y + late
        end = int(anchors[e - 1, 0]) + K
        if x >= end:
            continue
        if x > i or y > j:
            pairs = _matches(a[i:x], b[j:y])
            out.append(np.where(pairs >= 0, pairs + np.array([i, j]), -1))
        n = end - x
        wrong = np.flatnonzero(a[x:end] != b[y : y + n])
        if 5 * len(wrong) <= n:
            straight(x, y, n)
        else:  # align the gaps between the anchors one by one
            for u in (anchors[s:e, 0]).tolist():
                v = u - int(diagonal[s])
                if u > x:
                    pairs = _matches(a[x:u], b[y:v])
                    out.append(np.where(pairs >= 0, pairs + np.array([x, y]), -1))
                    x, y = u, v
                if u + K > x:
                    straight(x, y, u + K - x)
                    x, y = u + K, v + K
        i, j = end, end - int(diagonal[s])
    ahead = _Side(a[i:], b[j:])
    core = np.concatenate(out)
    gain = _gains(a, b, core)
    # Each side may spend what the best stretch up to it has gained.
    up, total = np.cumsum(gain), int(gain.sum())
    before = back.pairs(max(int(up.max()), total + ahead.best))[::-1]
    after = ahead.pairs(max(int((total - up + gain).max()), total + back.best))
    return np.concatenate([np.where(before >= 0, first - before, -1), core, np.where(after >= 0, after + np.array([i, j]), -1)])


def stretches(same: np.ndarray, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Disjoint longest stretches of columns of which at least 0.8 agree, their outer ones too.
    Their length is counted in columns, or in those that are ``own`` (hold a word of the text)."""
    out, work = [], [(0, len(same))]
    total = np.concatenate([[0], np.cumsum(np.where(same, SAME, EDIT))])
    words = np.concatenate([[0], np.cumsum(np.ones(len(same), dtype=bool) if own is None else own)])
    while work:
        low, high = work.pop()
        begins = low + np.flatnonzero(same[low:high])
        if not len(begins) or words[high] - words[low] < LEAST_WORDS:
            continue
        # The farthest end whose sum is no lower: the best sum from an end on never rises.
        ahead = np.maximum.accumulate(total[begins + 1][::-1])
        ends = begins[len(begins) - 1 - np.searchsorted(ahead, total[begins])] + 1
        k = int(np.argmax(words[ends] - words[begins]))
        begin, end = int(begins[k]), int(ends[k])
        if words[end] - words[begin] < LEAST_WORDS:
            continue
        work += [(low, begin), (end, high)]
        out.append((begin, end))
    return sorted(out)


def _identity(key: str, text: str) -> list[Column]:
    """(id, tag) tells rows apart: the key (a hash of the text if null) and a hash of the text,
    negative for rows without a key."""
    tag = F.hash(text).bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.coalesce(F.col(key).cast("long"), F.xxhash64(text)).alias("id"), F.when(F.col(key).isNull(), -1 - tag).otherwise(tag).alias("tag")]


_RUNS = [f"run{size}" for size in RUNS]


def _seeds(rows: DataFrame) -> DataFrame:
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch):
                owner, place, h = minimisers(words)
                who = pa.array(owner, pa.int64())
                longer = [pa.array(x, pa.int32(), mask=~whole) for x, whole in runs(words, owner, place)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(who), part.column(1).take(who), pa.array(place, pa.int32()), *longer], names=["h", "id", "tag", "pos", *_RUNS])

    return rows.select("id", "tag", "text").mapInArrow(tasks, "h long, id long, tag int, pos int" + "".join(f", {c} int" for c in _RUNS))


def _anchors(hits: DataFrame, by: list[str]) -> DataFrame:
    """Each place of a seed (or of a longer run) that repeats with its first place, if that is
    in another document."""
    earliest = F.min(F.struct(F.expr("tag < 0").alias("unnamed"), "id", "tag", "pos")).alias("f")
    first = hits.groupBy(*by).agg(earliest, F.count("*").alias("n")).filter("n > 1").select(*by, F.col("f.id").alias("sid"), F.col("f.tag").alias("stag"), F.col("f.pos").alias("spos"))
    return hits.join(first, by).filter("id != sid OR tag != stag").select("id", "tag", "sid", "stag", "pos", "spos")


_CHAIN = "id long, tag int, sid long, stag int, at array<int>, of array<int>"


def _chain_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors come sorted by both documents; each pair of documents is one run of rows."""
    held = None
    names = ["id", "tag", "sid", "stag"]

    def flush(parts: list[np.ndarray], last: bool):
        keys = np.stack(parts[:4], axis=1)
        new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        ends = np.append(new[1:], len(keys))
        many = len(new) if last else len(new) - 1
        rows: list[tuple] = []
        for s, e in zip(new[:many].tolist(), ends[:many].tolist(), strict=True):
            at, of = parts[4][s:e], parts[5][s:e]
            for chain in chains(at, of) if e - s > 1 else [[0]]:
                rows.append((*keys[s].tolist(), at[chain], of[chain]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[*names, "at", "of"])
        return out, None if last else [p[new[-1] :] for p in parts]

    for table in gathered(batches, 1 << 14):
        parts = [table.column(c).to_numpy() for c in range(6)]
        if held is not None:
            parts = [np.concatenate(p) for p in zip(held, parts, strict=True)]
        out, held = flush(parts, False)
        yield out
    if held is not None and len(held[0]):
        yield flush(held, True)[0]


_SPANS = "id long, tag int, lo int, hi int, sid long, stag int, slo int, shi int, at array<int>, of array<int>, words array<int>"


def _span_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words (32 bits of their hashes) of the stretches that are asked for, cut from each
    text once: with the whole chain for the text's own chains, alone for others' (no sid)."""
    names = [c.split()[0] for c in _SPANS.split(", ")]
    whole, short = pa.int64(), pa.int32()
    kinds = [whole, short, short, short, whole, short, short, short, pa.list_(short), pa.list_(short), pa.list_(short)]
    for batch in batches:
        for part, words in slices(batch):
            h = (_lowered(words) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            rows = []
            for d, (i, t, key, mine, given) in enumerate(zip(*(part.column(c).to_pylist() for c in ("id", "tag", "key", "mine", "given")), strict=True)):
                own = h[words.first[d] : words.first[d + 1]]
                rows += [(key, i, t, *c.values(), own[c["lo"] : c["hi"]]) for c in mine]
                rows += [(key, i, t, g["lo"], g["hi"], *[None] * 6, own[g["lo"] : g["hi"]]) for g in given]
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) + 1)
            types = [part.schema.field("key").type, *kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, types, strict=True)], names=["key", *names])


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, source, source_start, source_end, matched): stretches of at least 40
    words of a document that an earlier one holds too, word positions from 0, ends exclusive.

    At least 0.8 of the aligned words agree (``matched`` of them), in any ASCII case. Every
    repeated seed, and every repeated run of RUNS words from one on, is linked to its first
    document, by key and for equal keys by a hash of the text, so a document may hold stretches
    of several sources. Passages repeated within one
    document only don't count. Null and short texts hold none. Rows equal in key and text
    are one document; rows with a null key are told apart by their texts. Keys are integers;
    other columns are neither read nor returned.
    """
    settle(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), *_identity(key, text), body.alias("text"))
    seeds = _seeds(rows)
    often = seeds.select("h").groupBy("h").count().filter("count > 1").select("h")
    hits = pinned(seeds.join(often.hint("shuffle_hash"), "h"))
    anchors = _anchors(hits, ["h"])
    for c in _RUNS:  # a null run joins nothing
        anchors = anchors.union(_anchors(hits.filter(F.col(c).isNotNull()), ["h", c]))
    anchors = anchors.distinct()
    pair = ["id", "tag", "sid", "stag"]
    found = pinned(anchors.repartition(*pair).sortWithinPartitions(*pair, "pos", "spos").mapInArrow(_chain_tasks, _CHAIN))
    last = lambda c: F.element_at(c, -1) + K + REACH
    before = lambda c: F.greatest(F.element_at(c, 1) - REACH, F.lit(0))
    asked = found.select("*", before("at").alias("lo"), last("at").alias("hi"), before("of").alias("slo"), last("of").alias("shi"))
    # Each list is one text's own: its chains, and the stretches that others ask of it.
    mine = asked.select("id", "tag", F.struct("lo", "hi", "sid", "stag", "slo", "shi", "at", "of").alias("mine")).groupBy("id", "tag").agg(F.collect_list("mine").alias("mine"))
    given = asked.select(F.col("sid").alias("id"), F.col("stag").alias("tag"), F.struct(F.col("slo").alias("lo"), F.col("shi").alias("hi")).alias("given")).distinct()
    wishes = mine.join(given.groupBy("id", "tag").agg(F.collect_list("given").alias("given")), ["id", "tag"], "full")
    wanted = rows.join(wishes.hint("shuffle_hash"), ["id", "tag"]).dropDuplicates(["id", "tag"])
    lists = [F.coalesce(F.col(c), F.array()).alias(c) for c in ("mine", "given")]
    cut = pinned(wanted.select("id", "tag", "key", *lists, "text").mapInArrow(_span_tasks, plus(wanted.select("key").schema, _SPANS)))
    other = cut.filter("sid IS NULL").select(F.col("id").alias("sid"), F.col("tag").alias("stag"), F.col("key").alias("source"), F.col("lo").alias("slo"), F.col("hi").alias("shi"), F.col("words").alias("swords"))
    both = cut.filter("sid IS NOT NULL").join(other, ["sid", "stag", "slo", "shi"]).select("key", "source", "lo", "slo", "at", "of", "words", "swords")
    shape = plus(both.select("key", "source").schema, "start int, end int, source_start int, source_end int, matched int")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            keys = [batch.column(c).to_pylist() for c in range(4)]
            lists = [(batch.column(c).flatten().to_numpy(), batch.column(c).value_lengths().to_numpy().cumsum()) for c in range(4, 8)]
            for r, (k, s, lo, slo) in enumerate(zip(*keys, strict=True)):
                at, of, a, b = (v[ends[r - 1] if r else 0 : ends[r]] for v, ends in lists)
                if not alike(a, b):
                    continue  # no room for a passage
                pairs = align(a, b, np.stack([at - lo, of - slo], axis=1))
                same = _gains(a, b, pairs) == SAME
                for x, y in stretches(same, pairs[:, 0] >= 0):
                    i, j = (pairs[x:y, c][pairs[x:y, c] >= 0] for c in (0, 1))
                    rows.append((k, s, lo + int(i[0]), lo + int(i[-1]) + 1, slo + int(j[0]), slo + int(j[-1]) + 1, int(same[x:y].sum())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [batch.schema.field("key").type, batch.schema.field("source").type, *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["key", "source", "start", "end", "source_start", "source_end", "matched"])

    return both.mapInArrow(tasks, shape).distinct().withColumnRenamed("key", key)
