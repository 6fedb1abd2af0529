"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

Every three consecutive lines of a text are hashed; a window seen more than once anywhere
keeps its first occurrence, by document key and position, and the lines that later ones
cover go. Overlapping windows merge into longer passages by the union of their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.session import pinned

WINDOW = 3


def _window_hashes(lines: Column) -> Column:
    """(pos, 128-bit hash) of each window that holds a non-blank line. Lines are hashed
    once; a window is the hash of its lines' hashes."""
    hashed = F.transform(lines, lambda x: F.struct(F.md5(x).alias("h"), (F.trim(F.regexp_replace(x, r"[\t\x0B\f\r]", "")) == "").alias("blank")))

    def window(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)

        def one(i: Column) -> Column:
            of = [F.get(hashes, i + k) for k in range(WINDOW)]
            blank = of[0]["blank"]
            for x in of[1:]:
                blank = blank & x["blank"]
            return F.when(~blank, F.struct(i.alias("pos"), F.unhex(F.md5(F.concat(*[x["h"] for x in of]))).alias("hash")))

        return F.when(F.size(hashes) >= WINDOW, F.transform(starts, one))

    # A one-element array binds the hashed lines to a name, so that they are computed once.
    return F.flatten(F.transform(F.array(hashed), window))


def _repeats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, gone): per text the starts of windows that occur earlier."""
    lines = F.split(F.col(text), "\n", -1)
    cut = docs.filter(F.col(text).contains("\n")).select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("digest"), _window_hashes(lines).alias("w"))
    windows = pinned(cut.select("key", "digest", F.explode("w").alias("w")).filter("w IS NOT NULL").select("key", "digest", "w.pos", "w.hash"))
    at = F.struct(F.col("key").isNull().alias("unnamed"), "key", "digest", "pos")
    seen = windows.groupBy("hash").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first != last").select("hash", "first")
    later = windows.join(seen, "hash").filter(at != F.col("first"))
    # One document's own positions: as many as it has lines.
    return later.groupBy("key", "digest").agg(F.collect_set("pos").alias("gone"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later occurrences of repeated three-line windows cut from ``text``, and
    the counts ``lines_seen`` and ``lines_cut`` (columns so named before are replaced).

    Lines are compared byte for byte; windows of blank lines only never count. The order of
    documents is by key, nulls last; texts under one key go by their hash. Rows equal in key
    and text are one document, so both keep or lose the same lines. Texts of fewer than
    three lines stay as they are; null texts stay null with no lines.
    """
    docs = docs.drop("lines_seen", "lines_cut")
    gone = _repeats(docs, key, text).withColumnsRenamed({"key": "__key", "digest": "__digest", "gone": "__gone"})
    same = docs[key].eqNullSafe(gone["__key"]) & (F.xxhash64(docs[text]) == gone["__digest"])
    lines = F.split(F.col(text), "\n", -1)
    seen = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    covered = F.array_distinct(F.flatten(F.transform("__gone", lambda s: F.array(*[s + k for k in range(WINDOW)]))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__covered")
    # The table of repeats is the built side: texts are shuffled once and never sorted.
    marked = docs.join(gone.hint("shuffle_hash"), same, "left").drop("__key", "__digest")
    whole = marked.withColumns({"__lines": F.when(F.col("__gone").isNotNull(), lines), "__covered": covered, "lines_seen": seen})
    return whole.withColumns(
        {
            text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")),
            "lines_cut": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__covered")),
        }
    ).select(*docs.columns, "lines_seen", "lines_cut")
