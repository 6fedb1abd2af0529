"""Words of whole texts as numpy arrays over Arrow buffers.

A word is a run of ``[^\\x20\\x09-\\x0D]``. The separators are single bytes of UTF-8, so
words are found in the bytes of a column without decoding it. All helpers work on slices of
a few megabytes, so the memory of a task does not depend on the size of its batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

#: Bytes of text that one step of a task holds in numpy arrays (one longer text is one step).
SLICE_BYTES = 1 << 21
#: Rows of an Arrow batch between the JVM and Python: whole texts, so few rows.
BATCH_ROWS = 256

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD_BASE = np.uint64(0x9E3779B97F4A7C15)


def settle(spark: SparkSession) -> None:
    """Small Arrow batches, because a row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        _POWERS["up"] = _powers(_ODD_BASE, size)
        _POWERS["down"] = _powers(_inverse(_ODD_BASE), size)
    return _POWERS["up"], _POWERS["down"]


#: Lower-case form of each byte, and what parts words when punctuation doesn't count.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of the texts of a slice. ``first[d]`` is the index of the first word of text d;
    ``first`` has one more entry than there are texts."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def inside(self) -> np.ndarray:
        """Whether each byte belongs to a word (of the usual separators)."""
        return ~_SEPARATOR[self.data]

    def owner(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(self.texts), self.counts)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word's bytes (of ``data`` in place of the text's, if given)."""
        data = self.data if data is None else data
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            base = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, base + SLICE_BYTES, side="right")))
            stop = int(self.ends[to - 1])
            up, down = _power_tables(stop - base + 1)
            total = np.zeros(stop - base + 1, dtype=np.uint64)
            np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=total[1:])
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            at = to
        return mix(out)

    def windows(self, size: int) -> np.ndarray:
        """Index of the first word of every window of ``size`` words inside one text."""
        if len(self.starts) < size:
            return np.empty(0, dtype=np.int64)
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(self.starts))
        return at[at + size <= last]


def find(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> Words:
    """Words of texts that lie one after another in ``data``; ``separator`` marks the bytes
    between words."""
    offsets = offsets.astype(np.int64)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(separator[data], out=inside[1:-1])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if ends is None or len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(ends, dtype=kind)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)), offsets


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES, separator: np.ndarray = _SEPARATOR) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Parts of a batch with at most ``size`` bytes of text (or one text), with their words."""
    at = 0
    texts = batch.column(batch.schema.get_field_index(column))
    data, offsets = buffers(texts)
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + size, side="right")) - 1)
        yield batch.slice(at, to - at), find(data, offsets[at : to + 1], separator)
        at = to


def plus(schema: StructType, ddl: str) -> StructType:
    """A schema with more columns behind it."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Narrow batches put together, so that each numpy step has ``rows`` rows or more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
