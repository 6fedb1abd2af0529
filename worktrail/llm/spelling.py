"""Groups of spelling variants through one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols, so a word's full one-edit neighbourhood has a few
dozen reduced words per symbol of its length instead of hundreds, and words one edit apart
have reduced words at most one edit apart. The neighbourhoods are joined with the vocabulary
of reduced words, and what meets is verified on the original strings.

A bitmap of fixed size over the reduced vocabulary spares the join most neighbours that no
word has; it only ever lets too many through. Reduced words are 64-bit polynomials of their
symbols: equal words have equal keys, and a clash of different ones costs a verification.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.llm.bitmap import bitmap, may_hold
from worktrail.llm.words import buffers, gathered, mix, settle
from worktrail.session import pinned

SYMBOLS = 8
MIN_LETTERS, MIN_COUNT, DOMINANCE = 7, 2, 10
#: One in so many runs of a document loses a letter.
SLIP = 31
#: Distinct words that a task counts before it passes them on.
COUNTED = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, letters) of the maximal runs of [A-Za-z\\u00C0-\\u00FF] in texts that lie one
    after another. In UTF-8 the latter are the byte C3 and one byte more."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    lead = data == 0xC3
    inside[1:-1] = _LETTER[data] | lead
    inside[2:-1] |= lead[:-1]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    wide = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, (ends - starts) - (wide[ends] - wide[starts])


def _without(run: bytes, at: int) -> bytes:
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def _texts_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): words of whole texts after their slips, counted in parts."""
    counted: dict[bytes, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()).cast(pa.string()), pa.array(list(counted.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for at, key in enumerate(batch.column(0).to_pylist()):
            begin, end = int(offsets[at]), int(offsets[at + 1])
            seed = zlib.crc32(b":" if key is None else b"%d:" % key)
            # A long text is read in stretches that end at a byte outside of all runs.
            for s, e in _stretches(data, begin, end):
                part = data[s:e]
                starts, ends, letters = _runs(part, np.array([0, e - s]))
                long = letters >= MIN_LETTERS
                raw = part.tobytes().lower()
                for a, b, n in zip(starts[long].tolist(), ends[long].tolist(), letters[long].tolist(), strict=True):
                    run = raw[a:b]
                    h = zlib.crc32(run, seed)
                    if h % SLIP == 0:
                        if n == MIN_LETTERS:
                            continue
                        run = _without(run, h % n)
                    counted[run] = counted.get(run, 0) + 1
                if len(counted) >= COUNTED:
                    yield rows()
                    counted.clear()
    if counted:
        yield rows()


def _stretches(data: np.ndarray, begin: int, end: int, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    while end - begin > size:
        part = data[begin + size : end]
        blank = np.flatnonzero(part[: 1 << 16] < 65)
        if not len(blank):
            blank = np.flatnonzero(part < 65)
        if not len(blank):
            break
        cut = begin + size + int(blank[0])
        yield begin, cut
        begin = cut
    yield begin, end


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of ``docs`` with MIN_LETTERS letters and MIN_COUNT occurrences.

    Runs of letters, lower-cased in A-Z; a run whose crc32 with its document's key is a multiple
    of SLIP loses one letter. Null texts have no words; a null key counts as an empty one.
    """
    settle(docs.sparkSession)
    counted = docs.select(F.col(key).cast("long"), text).mapInArrow(_texts_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _symbols(points: np.ndarray) -> np.ndarray:
    """The symbol of each letter, from 1 on."""
    return (mix(points.astype(np.uint64) + np.uint64(11)) % np.uint64(SYMBOLS)) + np.uint64(1)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of symbols) for the words of each length, in parts of bounded size."""
    data, offsets = buffers(words)
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets.astype(np.int64) - base
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts = heads[offsets[:-1]]
    lengths = np.diff(heads[offsets])
    symbols = _symbols(points)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, b in pairwise([*cuts.tolist(), len(order)]):
        n = int(lengths[order[a]])
        step = max(1, (1 << 20) // max(1, n * SYMBOLS * 2))
        for at in range(a, b, step):
            rows = order[at : min(b, at + step)]
            yield rows, symbols[starts[rows][:, None] + np.arange(n)]


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _keys(symbols: np.ndarray) -> np.ndarray:
    """The key of each reduced word."""
    return mix((symbols * _powers(symbols.shape[1])[:-1]).sum(axis=1, dtype=np.uint64))


def _neighbourhood(symbols: np.ndarray) -> np.ndarray:
    """Keys of each reduced word and of all that one inserted, deleted or replaced symbol
    makes of it, a row per word; equal results repeat."""
    m, n = symbols.shape
    up = _powers(n)
    terms = symbols * up[:-1]
    before = np.zeros((m, n + 1), dtype=np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    after = whole - before
    out = [whole, before[:, :-1] + after[:, 1:] * _UNDO]
    for symbol in range(1, SYMBOLS + 1):
        other = up * np.uint64(symbol)
        out.append(whole - terms + other[:-1])
        out.append(before + other + after * _BASE)
    return mix(np.concatenate(out, axis=1))


_KEYED = "key long, word string, n long"


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of each word's reduced form."""
    for table in gathered(batches):
        words = table.column("word").combine_chunks()
        keys = np.empty(len(words), dtype=np.uint64)
        for rows, symbols in _by_length(words):
            keys[rows] = _keys(symbols)
        yield from pa.Table.from_arrays([pa.array(keys.view(np.int64)), table.column("word"), table.column("n")], names=["key", "word", "n"]).to_batches()


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each word with each that differs from it by exactly one
    inserted, deleted or replaced letter; both directions. ``vocab``: (word, n), words distinct."""
    keyed = pinned(vocab.select("word", "n").mapInArrow(_own, _KEYED))
    shared = vocab.sparkSession.sparkContext.broadcast(bitmap(keyed, "key"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for table in gathered(batches):
            words = table.column("word").combine_chunks()
            for rows, symbols in _by_length(words):
                keys = _neighbourhood(symbols)
                who, at = np.nonzero(may_hold(held, keys))
                found = keys[who, at]
                order = np.lexsort((found, who))
                who, found = who[order], found[order]
                new = np.ones(len(who), dtype=bool)
                new[1:] = (who[1:] != who[:-1]) | (found[1:] != found[:-1])
                kept = table.select(["word", "n"]).take(pa.array(rows[who[new]]))
                yield from pa.Table.from_arrays([pa.array(found[new].view(np.int64)), *kept.columns], names=["key", "word", "n"]).to_batches()

    offered = keyed.select("word", "n").mapInArrow(around, _KEYED)
    home = keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    return offered.join(home, "key").filter((F.abs(F.char_length("word") - F.char_length("other")) <= 1) & one_edit(F.col("word"), F.col("other"))).drop("key")


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form: the last word that forms lead to. Counts
    grow tenfold with every form, so pointers double a few times only."""
    links = pinned(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = pinned(links.join(ahead.hint("shuffle_hash"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n.

    ``form`` is the commonest word one edit away (ties: the first in code-point order), if it
    occurs at least DOMINANCE times as often; ``root`` the end of the chain of forms, the word
    itself without one. Tables without such words give no rows; only key and text are read.
    """
    vocab = pinned(vocabulary(docs, key, text))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best")
    near = near_pairs(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best)
    leads = F.col("best.m") <= -DOMINANCE * F.col("n")
    formed = pinned(
        vocab.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.w")).alias("form"), F.when(leads, -F.col("best.m")).alias("form_n")
        )
    )
    ends = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
