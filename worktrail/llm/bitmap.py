"""A bitmap of fixed size over a column of well-mixed 64-bit keys: may hold, or surely doesn't."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 ** BITS bits whatever the number of keys, in segments of 2 ** SEGMENT bits.
BITS, SEGMENT = 27, 20


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """The keys' leading bits as a bitmap, built by segments. A full one lets all keys pass."""
    bits, segment = BITS, SEGMENT

    def held(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << segment, dtype=bool)
        out[table.column("low").to_numpy()] = True
        return pa.table({"segment": table.column("segment").slice(0, 1), "held": pa.array([np.packbits(out).tobytes()], pa.binary())})

    places = keys.select(F.shiftrightunsigned(column, 64 - bits).alias("place")).distinct()
    split = places.select(F.shiftright("place", segment).alias("segment"), F.col("place").bitwiseAND((1 << segment) - 1).alias("low"))
    # A row of fixed size for each segment: 2 ** (bits - 3) bytes in all.
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    wide = 1 << (segment - 3)
    for row in split.groupBy("segment").applyInArrow(held, "segment long, held binary").collect():
        out[row.segment * wide : (row.segment + 1) * wide] = np.frombuffer(row.held, dtype=np.uint8)
    return out


def may_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (unsigned) may be among those of the bitmap."""
    place = keys >> np.uint64(64 - (len(held).bit_length() + 2))
    return ((held[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
