"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within 3 bits agree on at least one of their four 16-bit blocks. Four rotations
put each block in front; a rotated table is sorted by Gray rank (neighbours differ in few
bits) over many tasks and cut into leaves of at most ``LEAF`` neighbours that share their
leading block. Every leaf keeps the bits that all its members share; upper nodes keep what
``FAN`` leaves share. Two nodes whose shared bits differ in more than 3 places are pruned
with everything below them, so only members of near leaves are compared.

A dense leaf yields one link per member (a spanning forest), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.llm.components import components
from worktrail.llm.words import LOWER, gathered, plus, settle, slices
from worktrail.session import pinned

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Members of a leaf and leaves of an upper node: sizes of the index, not limits.
LEAF = 256
FAN = 64


def _fingerprints(words) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text of a slice."""
    # Lower-case bytes with one space after each word.
    lengths = words.ends - words.starts
    starts = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int((lengths + 1).sum()), 0x20, dtype=np.uint8)
    held = np.ones(len(joined), dtype=bool)
    held[starts + lengths] = False
    joined[held] = LOWER[words.data[words.inside()]]
    ends = starts + lengths
    # The windows of each text; a text of fewer words is one window.
    n = np.minimum(words.counts, SHINGLE)
    per_text = np.where(n > 0, words.counts - n + 1, 0)
    owner = np.repeat(np.arange(words.texts), per_text)
    first = words.first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    raw, digest = joined.tobytes(), xxhash.xxh64_digest
    out = np.zeros((words.texts, 64), dtype=np.int64)
    step = 1 << 18
    for at in range(0, len(first), step):
        i, who = first[at : at + step], owner[at : at + step]
        hashes = b"".join([digest(raw[s:e], SEED) for s, e in zip(starts[i].tolist(), ends[i + n[who] - 1].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        begins = np.flatnonzero(np.diff(who, prepend=-1))
        out[who[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * out > per_text[:, None], axis=1)
    return set_bits.reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """The rows of ``docs`` without their text, with a 64-bit SimHash (long). Null and empty
    texts have fingerprint 0. Other columns pass through; one called ``to`` is replaced."""
    settle(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, to)]
    shape = plus(docs.select(*rest).schema, f"{to} long")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, text):
                kept = [part.column(part.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(_fingerprints(words).view(np.int64))], names=[*rest, to])

    return docs.select(*rest, text).mapInArrow(tasks, shape)


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _rotated(prints: DataFrame) -> DataFrame:
    """(turn, code, gray): four rotations of each fingerprint, with their Gray rank."""
    turned = prints.select(F.col("fp"), F.explode(F.array(*[F.lit(t) for t in range(4)])).alias("turn"))
    left = F.expr("CASE WHEN turn = 0 THEN fp ELSE shiftleft(fp, 16 * turn) | shiftrightunsigned(fp, 64 - 16 * turn) END")
    rank = F.col("code")
    table = turned.select("turn", left.alias("code"))
    for k in (1, 2, 4, 8, 16, 32):
        table = table.withColumn("gray", rank.bitwiseXOR(F.shiftrightunsigned(rank, k)))
        rank = F.col("gray")
        table = table.select("turn", "code", "gray")
    # Signed comparison must order the unsigned rank.
    return table.withColumn("gray", F.col("gray").bitwiseXOR(F.lit(-(1 << 63))))


def _turn_back(codes: np.ndarray, turn: int) -> np.ndarray:
    if turn == 0:
        return codes
    return (codes >> np.uint64(16 * turn)) | (codes << np.uint64(64 - 16 * turn))


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Smallest index that each node reaches through links (a, b); ``root`` so far."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


_LEAVES = "turn int, block int, part int, seq long, ones long, any long, members array<long>, roots array<long>, a long, b long"
_LEAF_NAMES = ["turn", "block", "part", "seq", "ones", "any", "members", "roots", "a", "b"]


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into leaves. A row is a link inside a leaf (a, b), or a leaf
    whose block may go on elsewhere: more than one leaf, or at an end of the partition."""
    held: tuple[np.ndarray, np.ndarray] | None = None
    run_at, first_run = 0, True  # leaves already cut from the run that is held back

    def cut(turn: np.ndarray, code: np.ndarray, part: int, run_at: int, first: bool, last: bool):
        key = (turn.astype(np.int64) << 16) | (code >> np.uint64(48)).astype(np.int64)
        run = np.cumsum(np.diff(key, prepend=key[0]) != 0)
        begins = np.flatnonzero(np.diff(run, prepend=-1))
        place = np.arange(len(code)) - begins[run]
        leaf_no = place // LEAF + np.where(run == 0, run_at, 0)
        begin = np.flatnonzero(place % LEAF == 0)
        size = np.diff(np.append(begin, len(code)))
        leaf = np.repeat(np.arange(len(begin)), size)
        root = np.arange(len(code))
        pairs = []
        for step in range(1, int(size.max())):
            i = np.flatnonzero(leaf[:-step] == leaf[step:]) if step < len(leaf) else np.empty(0, dtype=np.int64)
            near = i[np.bitwise_count(code[i] ^ code[i + step]) <= DISTANCE]
            if len(near):
                pairs.append((near, near + step))
            if len(pairs) >= 32:
                root = _forest(*(np.concatenate(x) for x in zip(*pairs, strict=True)), root)
                pairs = []
        if pairs:
            root = _forest(*(np.concatenate(x) for x in zip(*pairs, strict=True)), root)
        back = np.empty(len(code), dtype=np.uint64)
        for t in np.unique(turn):
            back[turn == t] = _turn_back(code[turn == t], int(t))
        back = back.view(np.int64)
        linked = np.flatnonzero(root != np.arange(len(code)))
        runs = int(run[-1]) + 1
        leaves_of_run = np.bincount(run[begin], minlength=runs)
        shown = (leaves_of_run[run[begin]] > 1) | (size == LEAF) | (leaf_no[begin] > 0)
        shown |= (run[begin] == 0) & first
        shown |= (run[begin] == runs - 1) & last
        rows: dict[str, list] = {c: [] for c in _LEAF_NAMES}
        for k in np.flatnonzero(shown):
            s, e = begin[k], begin[k] + size[k]
            rows["turn"].append(int(turn[s]))
            rows["block"].append(int(code[s] >> np.uint64(48)))
            rows["part"].append(part)
            rows["seq"].append(int(leaf_no[s]))
            rows["ones"].append(np.bitwise_and.reduce(back[s:e]).item())
            rows["any"].append(np.bitwise_or.reduce(back[s:e]).item())
            rows["members"].append(back[s:e])
            rows["roots"].append(back[root[s:e]])
        many = len(rows["turn"])
        out = {
            **{c: rows[c] + [None] * len(linked) for c in _LEAF_NAMES[:8]},
            "a": [None] * many + back[linked].tolist(),
            "b": [None] * many + back[root[linked]].tolist(),
        }
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(_LEAF_NAMES, kinds, strict=True)], names=_LEAF_NAMES)

    part = 0
    for batch in gathered(batches):
        turn = batch.column(0).to_numpy()
        code = batch.column(1).to_numpy().view(np.uint64)
        part = int(batch.column(2)[0].as_py())
        if held is not None:
            turn, code = np.concatenate([held[0], turn]), np.concatenate([held[1], code])
        # Hold back the last run, but for its full leaves.
        same = np.flatnonzero((turn != turn[-1]) | (code >> np.uint64(48) != code[-1] >> np.uint64(48)))
        begin = int(same[-1]) + 1 if len(same) else 0
        keep = begin + (len(code) - begin) // LEAF * LEAF
        before = run_at
        if keep:
            yield cut(turn[:keep], code[:keep], part, run_at, first_run, False)
            first_run = first_run and begin == 0
        run_at = (len(code) - begin) // LEAF + (before if begin == 0 else 0)
        held = turn[keep:], code[keep:]
    if held is not None and len(held[1]):
        yield cut(*held, part, run_at, first_run, True)


def _near_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One link for each two leaf components with members within reach."""
    for batch in batches:
        found: set[tuple[int, int]] = set()
        for x, xr, y, yr in zip(*(batch.column(k) for k in range(4)), strict=True):
            p, q = (v.values.to_numpy().view(np.uint64) for v in (x, y))
            i, j = np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= DISTANCE)
            if len(i):
                ends = np.stack([xr.values.to_numpy()[i], yr.values.to_numpy()[j]], axis=1)
                found.update(map(tuple, np.unique(ends, axis=0).tolist()))
        a, b = zip(*sorted(found), strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _differ(x: str, y: str) -> str:
    """Places where all below x have one value and all below y have the other."""
    return f"bit_count(({x}.ones & ~{y}.any) | ({y}.ones & ~{x}.any)) <= {DISTANCE}"


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``fp`` exactly as all pairs within
    DISTANCE bits do. A pair that others connect may be left out."""
    ranged = _rotated(prints).repartitionByRange("turn", "gray").sortWithinPartitions("turn", "gray")
    leaves = pinned(ranged.select("turn", "code", F.spark_partition_id().alias("part")).mapInArrow(_leaves, _LEAVES))
    inner = leaves.filter("a IS NOT NULL").select("a", "b")
    nodes = leaves.filter("a IS NULL").withColumn("up", F.expr(f"seq div {FAN}")).drop("a", "b")
    upper = nodes.groupBy("turn", "block", "part", "up").agg(F.bit_and("ones").alias("ones"), F.bit_or("any").alias("any"))
    tops = upper.alias("x").join(
        upper.alias("y"),
        F.expr(f"x.turn = y.turn AND x.block = y.block AND (x.part < y.part OR x.part = y.part AND x.up <= y.up) AND {_differ('x', 'y')}"),
    ).selectExpr("x.turn", "x.block", "x.part AS xp", "x.up AS xu", "y.part AS yp", "y.up AS yu")
    left = tops.join(nodes.select("turn", "block", F.col("part").alias("xp"), F.col("up").alias("xu"), F.struct("seq", "ones", "any", "members", "roots").alias("x")), ["turn", "block", "xp", "xu"])
    both = left.join(nodes.select("turn", "block", F.col("part").alias("yp"), F.col("up").alias("yu"), F.struct("seq", "ones", "any", "members", "roots").alias("y")), ["turn", "block", "yp", "yu"])
    near = both.filter(f"(xp < yp OR x.seq < y.seq) AND {_differ('x', 'y')}")
    outer = near.select("x.members", "x.roots", "y.members", "y.roots").toDF("x", "xr", "y", "yr").mapInArrow(_near_members, "a long, b long")
    return inner.unionAll(outer)


def _grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, digest of the text, fp) per row, and (fp, root) per fingerprint."""
    rows = docs.select(F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))
    rows = pinned(fingerprints(rows, "text", "fp"))
    prints = rows.select("fp").distinct()
    found = components(near_links(prints)).withColumnRenamed("node", "fp")
    return rows, pinned(prints.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest key among all documents that links of at most 3 differing bits reach.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a
    key stay separate rows. A null key never becomes a component's name unless all its
    documents have null keys. Only ``key`` and ``text`` are read, so other columns, and
    columns named like the results, don't matter. Empty tables give empty results.
    """
    rows, roots = _grouped(docs, key, text)
    lowest = rows.groupBy("fp").agg(F.min("key").alias("low"))
    names = lowest.join(roots, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = roots.join(names, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select(F.col("key").alias(key), hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: one document of each group stays, the
    one of the smallest key (nulls last) and, under one key, of the smallest text digest.
    Of rows equal in both, one stays. All columns are kept as they are."""
    rows, roots = _grouped(docs, key, text)
    first = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "digest")).alias("w")
    lowest = rows.groupBy("fp").agg(first, F.count("*").alias("n"))
    wins = lowest.join(roots, "fp").groupBy("root").agg(F.min("w").alias("w")).select("w.key", "w.digest")
    copies = rows.groupBy("key", "digest").agg(F.count("*").alias("_copies"))
    wins = wins.join(copies, wins["key"].eqNullSafe(copies["key"]) & (wins["digest"] == copies["digest"])).select(
        wins["key"].alias("_key"), wins["digest"].alias("_digest"), "_copies"
    )
    same = docs[key].eqNullSafe(F.col("_key")) & (F.md5(F.coalesce(docs[text], F.lit(""))) == F.col("_digest"))
    kept = pinned(docs.join(wins, same).select(*[docs[c] for c in docs.columns], "_copies", "_digest"))
    lone = kept.filter("_copies = 1").select(*docs.columns)
    return lone.unionAll(kept.filter("_copies > 1").dropDuplicates([key, "_digest"]).select(*docs.columns))
