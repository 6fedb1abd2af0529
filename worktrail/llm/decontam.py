"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A random walk reads a window of words; at each step it emits the word under its pointer and
moves on if a random bit of (step, word) says so. Windows of small edit distance have walks
that agree in most steps, so edit distance becomes Hamming distance. Each repetition samples
a few steps and hashes what was emitted there; windows and items that share a hash are
candidates, and an exact edit distance over words decides.

Windows start at every ``step`` words of a document and items are embedded at all their own
windows, so each occurrence of an item meets every aligned window that lies inside it.
Items are a stated query set: they are indexed in blocks, each held against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.llm.words import NOT_ALNUM, Words, buffers, find, mix, plus, settle, slices

SIMILARITY = 0.8
#: Words of the items of a block (or one longer item); each block is one pass over the documents.
BLOCK_WORDS = 1 << 15
#: Window classes (words, step). An item takes the longest that fits at all its shifts.
CLASSES = [(1, 1), (2, 2), (3, 3), (5, 4), (8, 8), (16, 8), (24, 8), (32, 8), (48, 8)]
#: Walks, samples of each walk and class, steps in a sample: for a recall of 0.95 or more at
#: the farthest distance that counts (tests measure it).
WALKS, SAMPLES, STEPS = 2, 8, 3
SEED = 11
#: Bits of a key that are looked up before the sorted keys are searched.
_BITMAP = 16


def _salt(*of: int) -> np.uint64:
    """A random-looking number for a walk, or for a walk, width and sample."""
    return mix(np.array([SEED + sum((x + 1) * 1_000_003**k for k, x in enumerate(of))], dtype=np.uint64))[0]


def sampled(walk: int, width: int) -> np.ndarray:
    """(sample, step) of the steps that a walk shows for windows of a width. The pointer
    moves half a word a step, so the first 2 * width - 1 steps see the window."""
    rng = np.random.default_rng([SEED, walk, width])
    last = max(1, 2 * width - 1)
    return np.stack([np.sort(rng.choice(last, min(STEPS, last), replace=False)) for _ in range(SAMPLES)])


def embed(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, widths: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(width, repetition, key per window) of windows at ``starts``; what lies at or past
    ``stops`` or outside the width is emitted as nothing."""
    for walk in range(WALKS):
        wanted = {w: sampled(walk, w) for w in widths}
        needed = {int(s) for w in widths for s in wanted[w].ravel()}
        steps = max(needed) + 1
        # Past the last word there is room for a pointer that moves at every step.
        symbols = np.zeros(len(hashes) + steps, dtype=np.uint64)
        symbols[: len(hashes)] = mix(hashes ^ _salt(walk))
        shown: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        at, here, turn = starts.copy(), np.empty(len(starts), dtype=np.uint64), np.empty(len(starts), dtype=np.uint64)
        for step in range(steps):
            np.take(symbols, at, out=here, mode="clip")
            if step in needed:
                seen = np.where(at < stops, here, np.uint64(0))
                shown[step] = seen, at - starts
            # The symbols are hashes, so each of their bits is a coin; past 64 steps they mix anew.
            np.right_shift(here if step < 64 else here * np.uint64(0x9E3779B97F4A7C15), np.uint64(step & 63), out=turn)
            np.bitwise_and(turn, np.uint64(1), out=turn)
            np.add(at, turn.view(np.int64), out=at)
        for w in widths:
            inside = {int(s): np.where(shown[int(s)][1] < w, shown[int(s)][0], np.uint64(0)) for s in np.unique(wanted[w])}
            for k, row in enumerate(wanted[w]):
                key = np.full(len(starts), _salt(walk, w, k), dtype=np.uint64)
                for s in row:
                    # Multiply and fold: each step's symbol is a hash already.
                    key = (key ^ inside[int(s)]) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(32)
                yield w, walk * SAMPLES + k, key * np.uint64(0x94D049BB133111EB)


@dataclass
class Index:
    """Items of a block: their words, and for each class and repetition the sorted keys."""

    ids: list
    first: np.ndarray
    hashes: np.ndarray
    keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    steps: dict[int, list[int]]
    maps: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bitmap(self, of: tuple[int, int]) -> np.ndarray:
        """Which leading bits occur among the keys; made by each task process for itself."""
        if of not in self.maps:
            self.maps[of] = np.zeros(1 << _BITMAP, dtype=bool)
            self.maps[of][self.keys[of][0] >> np.uint64(64 - _BITMAP)] = True
        return self.maps[of]

    def holds(self, item: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether a word may be one of the item's (never false for one that is)."""
        if (0, 0) not in self.maps:
            self.maps[0, 0] = np.zeros(1 << 22, dtype=bool)
            self.maps[0, 0][self._slot(np.repeat(np.arange(len(self.ids)), np.diff(self.first)), self.hashes)] = True
        return self.maps[0, 0][self._slot(item, words)]

    @staticmethod
    def _slot(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        return ((words ^ (item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)

    @property
    def edits(self) -> np.ndarray:
        return ((1 - SIMILARITY) * np.diff(self.first) + 1e-9).astype(np.int64)

    def words(self, item: int) -> np.ndarray:
        return self.hashes[self.first[item] : self.first[item + 1]]


def index(items: list[tuple]) -> Index:
    """Index (id, text) pairs. Items without words can't occur anywhere and are left out."""
    column = pc.utf8_lower(pa.array([t for _, t in items], pa.string()))
    words = find(*buffers(column), NOT_ALNUM) if items else None
    keep = [i for i in range(len(items)) if words.counts[i]] if items else []
    hashes = words.hashes() if items else np.empty(0, dtype=np.uint64)
    parts = [hashes[words.first[i] : words.first[i + 1]] for i in keep]
    first = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    by_class: dict[tuple[int, int], list[int]] = {}
    for k, p in enumerate(parts):
        fits = [c for c in CLASSES if c[0] + c[1] - 1 <= len(p)]
        by_class.setdefault(fits[-1], []).append(k)
    keys, steps = {}, {}
    for (width, step), members in by_class.items():
        steps.setdefault(step, []).append(width)
        shifts = [len(parts[k]) - width + 1 for k in members]
        item = np.repeat(members, shifts)
        shift = np.concatenate([np.arange(n) for n in shifts])
        for w, rep, key in embed(flat, first[item] + shift, first[item + 1], [width]):
            order = np.argsort(key, kind="stable")
            keys[w, rep] = key[order], item[order], shift[order]
    return Index([items[i][0] for i in keep], first, flat, keys, steps)


def _distances(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least word edits between an item and any stretch of each region (0 pads a region)."""
    n, m = regions.shape
    place = np.arange(m + 1)
    row = np.zeros((n, m + 1), dtype=np.int32)
    for word in item:
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != word))
        row = np.minimum.accumulate(new - place, axis=1) + place
    return row.min(axis=1)


def _parts(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of a batch with its texts in lower case."""
    i = batch.schema.get_field_index(text)
    return slices(batch.set_column(i, text, pc.utf8_lower(batch.column(i))), text, separator=NOT_ALNUM)


def find_items(words: Words, at: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, distance): the least distance of every item found in every text."""
    hashes = words.hashes()
    found: list[np.ndarray] = []
    for step, widths in at.steps.items():
        per_text = -(-words.counts // step)
        owner = np.repeat(np.arange(words.texts), per_text)
        starts = words.first[:-1][owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        if not len(starts):
            continue
        for w, rep, key in embed(hashes, starts, words.first[1:][owner], widths):
            keys, item, shift = at.keys[w, rep]
            hit = np.flatnonzero(at.bitmap((w, rep))[key >> np.uint64(64 - _BITMAP)])
            low, high = np.searchsorted(keys, key[hit], side="left"), np.searchsorted(keys, key[hit], side="right")
            n = high - low
            if n.any():
                hit, low, n = (x[n > 0] for x in (hit, low, n))
                which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                where = np.repeat(hit, n)
                found.append(np.stack([owner[where], item[which], starts[where] - shift[which]], axis=1))
    none = np.empty(0, dtype=np.int64)
    if not found:
        return none, none, none
    # One number per (text, place, item), so that repeated candidates sort away quickly.
    text, item, base = np.concatenate(found, axis=0).T
    longest, many = int(np.diff(at.first).max()), len(at.ids)
    room = len(hashes) + longest + 1
    tied = np.unique((text * room + base + longest) * many + item)
    item, base, text = tied % many, tied // many % room - longest, tied // many // room
    size, out = np.diff(at.first), []
    for rows in np.array_split(np.arange(len(item)), -(-len(item) * longest // (1 << 20))):
        n, edits = size[item[rows]], at.edits[item[rows]]
        # A region holds every stretch of a candidate that can be near enough.
        reach = np.arange(int((n + 2 * edits).max()))
        span = (base[rows] - edits)[:, None] + reach
        low, high = words.first[text[rows]], np.minimum(words.first[text[rows] + 1], base[rows] + n + edits)
        inside = (span >= low[:, None]) & (span < high[:, None])
        regions = np.where(inside, hashes[np.clip(span, 0, len(hashes) - 1)], np.uint64(0))
        # An alignment keeps all words but `edits`; a region with fewer words of the item can't do.
        own = at.holds(item[rows][:, None], regions) & inside
        enough = np.flatnonzero(own.sum(axis=1) >= n - edits)
        for i in np.unique(item[rows][enough]):
            these = enough[item[rows][enough] == i]
            distance = _distances(at.words(i), regions[these])
            near = distance <= at.edits[i]
            out.append(np.stack([text[rows][these[near]], np.full(near.sum(), i), distance[near]], axis=1))
    if not out:
        return none, none, none
    best = np.concatenate(out)
    if not len(best):
        return none, none, none
    best = best[np.lexsort((best[:, 2], best[:, 1], best[:, 0]))]
    new = np.ones(len(best), dtype=bool)
    new[1:] = (best[1:, :2] != best[:-1, :2]).any(axis=1)
    return tuple(best[new].T)


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[Index]:
    """Indexes of BLOCK_WORDS at a time; the driver never holds more of the items."""
    rows = items.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna().distinct().orderBy("key", "text").toLocalIterator()
    block, size = [], 0
    for row in rows:
        block.append((row["key"], row["text"]))
        size += row["text"].count(" ") + 1
        if size >= BLOCK_WORDS:
            yield index(block)
            block, size = [], 0
    if block:
        yield index(block)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, words, distance, similarity): per row of ``docs`` and item found in it
    the item's words, the least edit distance and 1 - distance / words, at least 0.8.

    Words are runs of letters and digits, in any case. Null or wordless items are left
    out, null texts have no words, and no items give no rows. Documents with repeated keys
    give rows each; repeated items count once. Other columns are not read.
    """
    settle(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = plus(rows.select("key").schema.add("item", items.schema[item_key].dataType), "words int, distance int, similarity double")
    out = None
    for at in _blocks(items, item_key, item_text):
        # A block's index has a fixed size at most.
        shared = docs.sparkSession.sparkContext.broadcast(at)

        def tasks(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            at = shared.value
            for batch in batches:
                for part, words in _parts(batch):
                    who, item, distance = find_items(words, at)
                    size = at.first[item + 1] - at.first[item] if len(item) else item
                    columns = [
                        part.column(0).take(pa.array(who, pa.int64())), pa.array([at.ids[i] for i in item]), pa.array(size, pa.int32()),
                        pa.array(distance, pa.int32()), pa.array(1 - distance / np.maximum(size, 1), pa.float64()),
                    ]
                    if len(who):
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "item", "words", "distance", "similarity"])

        found = rows.mapInArrow(tasks, kinds)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], kinds)
    return out.withColumnsRenamed({"key": key, "item": item_key})


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all columns as they are."""
    settle(docs.sparkSession)
    columns = docs.columns
    for at in _blocks(items, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(at)

        def tasks(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean, at = np.ones(batch.num_rows, dtype=bool), 0
                for part, words in _parts(batch, text):
                    clean[at + find_items(words, shared.value)[0]] = False
                    at += part.num_rows
                yield batch.filter(pa.array(clean))

        docs = docs.select(*columns).mapInArrow(tasks, docs.schema)
    return docs
