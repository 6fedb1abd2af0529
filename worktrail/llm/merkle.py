"""Merkle manifest of a dataset as a postorder append log.

Every row is a leaf; every ``FAN`` consecutive nodes of a tree become one node above them.
The nodes of a tree form a log in completion order: a node follows its last child at once.
Where a node stands in that log follows from the sizes of the subtrees before it alone
(``address``), so builders work side by side: each takes an aligned range of leaves, whose
subtree fills one stretch of the log, and writes its nodes in completion order; builders of
the next tier take the tops of those ranges. Proofs address siblings by the same formula:
those inside a range are read off its own stretch, the few above it by a join on addresses.

Each value of the group column is a tree; the tops of the trees, in the order of the group
column (null first), are the leaves of one more tree, whose top is the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.llm.words import gathered
from worktrail.operators.ordering import beside, group_positions
from worktrail.session import pinned

FAN = 8
#: Levels that one builder adds to its range: ranges of FAN ** TIER nodes.
TIER = 3
RANGE = FAN**TIER
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree above all trees.
TOP = "top"


def sizes(n: int) -> list[int]:
    """Nodes of each level of a tree of ``n`` leaves, from the leaves up to its top."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def address(level: int, index: np.ndarray, n: int) -> np.ndarray:
    """Places of nodes in the postorder log of a tree of ``n`` leaves: as many nodes as are
    complete when the node is, below it and beside, and the complete ones above it."""
    index = np.asarray(index, dtype=np.int64)
    out = np.full(index.shape, -1, dtype=np.int64)
    for j, size in enumerate(sizes(n)):
        if j <= level:
            out += np.minimum((index + 1) * FAN ** (level - j), size)
        else:
            out += index // FAN ** (j - level)
    return out


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: of each field ``-`` if null, else its length in bytes, ``:`` and value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def _sha(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


_LOG = "tree string, n long, level int, idx long, address long, digest string"
_LOG_NAMES = ["tree", "n", "level", "idx", "address", "digest"]


def _built(base: int):
    """A builder: the nodes of one aligned range of level ``base``, and all that complete
    inside the range, in completion order. Level 0 itself is part of the log."""

    def build(table: pa.Table) -> pa.Table:
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        digests = table.column("digest").take(pa.array(order)).to_pylist()
        first = int(table.column("idx").to_numpy().min())
        levels, index, place, digest = [], [], [], []

        def keep(level: int, at: int, nodes: list[str]) -> None:
            many = np.arange(at, at + len(nodes))
            levels.append(np.full(len(nodes), level, dtype=np.int32))
            index.append(many)
            place.append(address(level, many, n))
            digest.extend(nodes)

        if base == 0:
            keep(0, first, digests)
        for level in range(base + 1, min(base + TIER, len(sizes(n)) - 1) + 1):
            digests = [_sha(digests[k : k + FAN]) for k in range(0, len(digests), FAN)]
            first //= FAN
            keep(level, first, digests)
        if not levels:
            return pa.table({c: pa.array([], t) for c, t in zip(_LOG_NAMES, _LOG_TYPES, strict=True)})
        where = np.concatenate(place)
        done = np.argsort(where, kind="stable")
        rows = len(done)
        columns = [
            pa.array([tree] * rows, pa.string()),
            pa.array(np.full(rows, n, dtype=np.int64)),
            pa.array(np.concatenate(levels)[done]),
            pa.array(np.concatenate(index)[done]),
            pa.array(where[done]),
            pa.array(digest, pa.string()).take(pa.array(done)),
        ]
        return pa.Table.from_arrays(columns, names=_LOG_NAMES)

    return build


_LOG_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]


def postorder_log(leaves: DataFrame) -> DataFrame:
    """The log of all trees of ``leaves`` (tree, n: leaves of the tree, idx from 0, digest):
    tree, n, level, idx, address, digest. Each tier of builders works on the tops of the
    ranges of the tier below, a ``RANGE``-th of its rows, until every tree has one top."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    level, log, nodes = 0, [], leaves.select("tree", "n", "idx", "digest")
    while True:
        ranges = nodes.withColumn("range", F.expr(f"idx div {RANGE}")).groupBy("tree", "range")
        log.append(pinned(ranges.applyInArrow(_built(level), _LOG)))
        level += TIER
        if -(-most // FAN**level) <= 1:
            break
        nodes = log[-1].filter(F.col("level") == level).select("tree", "n", "idx", "digest")
    whole = log[0]
    for tier in log[1:]:
        whole = whole.unionAll(tier)
    return whole


def _wanted(of: list[str], base: int):
    """Rows (of..., tree, n, idx at level ``base``) to one row per sibling on the way up."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 1 << 12):
            row, levels, index, place = [], [], [], []
            sibling_of = zip(table.column("n").to_pylist(), table.column("idx").to_pylist(), strict=True)
            for at, (n, i) in enumerate(sibling_of):
                up = sizes(n)
                for level in range(base, len(up) - 1):
                    run = i // FAN * FAN
                    many = np.array([k for k in range(run, min(run + FAN, up[level])) if k != i], dtype=np.int64)
                    row.append(np.full(len(many), at))
                    levels.append(np.full(len(many), level, dtype=np.int32))
                    index.append(many)
                    place.append(address(level, many, n))
                    i //= FAN
            if not row:
                continue
            kept = table.select([*of, "tree"]).take(pa.array(np.concatenate(row)))
            columns = [*kept.columns, pa.array(np.concatenate(levels)), pa.array(np.concatenate(index)), pa.array(np.concatenate(place))]
            yield from pa.Table.from_arrays(columns, names=[*of, "tree", "level", "idx", "address"]).to_batches()

    return tasks


def siblings(nodes: DataFrame, log: DataFrame, base: int = 0) -> DataFrame:
    """(columns of ``nodes``, level, sib, digest): the siblings of each node (tree, n, idx at
    level ``base``) on its way to the top, addressed in the log by the closed form."""
    of = [c for c in nodes.columns if c not in ("tree", "n", "idx")]
    shape = ", ".join([*(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in of), "tree string, level int, idx long, address long"])
    asked = nodes.select(*of, "tree", "n", "idx").mapInArrow(_wanted(of, base), shape)
    above = log.filter(F.col("level") >= base).select("tree", "address", "digest")
    return asked.join(above, ["tree", "address"]).select(*of, "tree", "level", F.col("idx").alias("sib"), "digest")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, altered: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a manifest of ``docs``:

    ``leaves`` (key, tree, n, idx, leaf, altered), ``log`` and ``top_log`` (postorder logs),
    ``trees`` (tree, group value, n, idx among trees, subroot).

    Leaves of a tree ascend by key, null keys first; rows equal in key ascend by digest, and
    rows equal in all fields are leaves of their own that share a digest. A null group is a
    tree of its own. An empty table has empty logs. A column ``_altered`` of ``docs``, if
    there, holds the digest that the row has now (null: unchanged). Columns other than
    ``fields``, key and group don't matter.
    """
    now = F.col("_altered") if "_altered" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("value"), leaf([F.col(c) for c in fields]).alias("leaf"), now.alias("altered"))
    rows = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("value").cast("string")), F.lit("-")))
    placed = group_positions(rows, ["tree"], ["key", "leaf"]).withColumnsRenamed({"pos": "idx", "group_rows": "n"})
    leaves = pinned(placed.select("key", "value", "tree", F.col("n").cast("long").alias("n"), F.col("idx").cast("long").alias("idx"), "leaf", "altered"))
    log = postorder_log(leaves.select("tree", "n", "idx", F.col("leaf").alias("digest")))
    # A tree's last address holds its top.
    tops = log.groupBy("tree").agg(F.max_by("digest", "address").alias("subroot"))
    tops = leaves.filter("idx = 0").select("tree", "value", "n").join(tops, "tree")
    ordered = group_positions(tops.withColumn("forest", F.lit(TOP)), ["forest"], ["value"])
    trees = pinned(ordered.select("tree", "value", "n", F.col("pos").cast("long").alias("idx"), F.col("group_rows").cast("long").alias("trees"), "subroot"))
    top_log = postorder_log(trees.select(F.lit(TOP).alias("tree"), F.col("trees").alias("n"), "idx", F.col("subroot").alias("digest")))
    return {"leaves": leaves, "log": log, "trees": trees, "top_log": top_log}


class Proofs:
    """A row per leaf with its siblings, level by level up to the root, and its own place
    in each run: what somebody needs who holds the row and the root only."""

    shape = "key long, leaf string, subroot string, root string, places array<int>, siblings array<array<string>>"
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.string()))]

    @staticmethod
    def row(key, own, now, subroot, root, places, around):
        return key, own, subroot, root, places, around


class Digests:
    """A row per leaf with the digest of its proof, and the root that the row as it is now
    folds to."""

    shape = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    @staticmethod
    def row(key, own, now, subroot, root, places, around):
        folded = fold(own if now is None else now, places, around)
        return key, own, subroot, root, _sha([d for run in around for d in run]), folded, folded == root


def fold(digest: str, places: list[int], around: list[list[str]]) -> str:
    """The root that a leaf digest leads to with these siblings."""
    for place, run in zip(places, around, strict=True):
        digest = _sha([*run[:place], digest, *run[place:]])
    return digest


def _extracted(sink):
    names = [c.split()[0] for c in sink.shape.split(", ")]

    def extract(stretch: pa.Table, asked: pa.Table) -> pa.Table:
        """One range: the nodes of its stretch of the log and those above it (``stretch``),
        and its leaves (``asked``)."""
        kind = stretch.column("kind").to_numpy()
        marks = {k: stretch.filter(pa.array(kind == k)) for k in (2, 3)}
        subroot, root = (marks[k].column("digest")[0].as_py() for k in (2, 3))
        inside = stretch.filter(pa.array(kind == 0)).sort_by("address")
        n, start = asked.column("n")[0].as_py(), inside.column("address")[0].as_py()
        written = inside.column("digest").to_pylist()
        up = sizes(n)
        upper: dict[tuple[int, int], dict[int, str]] = {}
        above = stretch.filter(pa.array((kind == 1) | (kind == 4)))
        for k, level, sib, digest in zip(*(above.column(c).to_pylist() for c in ("kind", "level", "idx", "digest")), strict=True):
            upper.setdefault((k, level), {})[sib] = digest
        first = int(asked.column("idx")[0].as_py()) // RANGE
        rest_places, rest_runs = [], []
        i = first
        for level in range(TIER, len(up) - 1):
            run = upper.get((1, level), {})
            rest_places.append(i % FAN)
            rest_runs.append([run[k] for k in sorted(run)])
            i //= FAN
        i, many = stretch.filter(pa.array(kind == 2)).select(["idx", "address"]).to_pylist()[0].values()
        for level in range(len(sizes(many)) - 1):
            run = upper.get((4, level), {})
            rest_places.append(i % FAN)
            rest_runs.append([run[k] for k in sorted(run)])
            i //= FAN
        # Places of this range's nodes in its stretch, by the closed form.
        lower = []
        for level in range(min(TIER, len(up) - 1)):
            begin = first * FAN ** (TIER - level)
            end = min(begin + FAN ** (TIER - level), up[level])
            lower.append((begin, end, (address(level, np.arange(begin, end), n) - start).tolist()))
        rows = []
        for key, idx, own, now in zip(*(asked.column(c).to_pylist() for c in ("key", "idx", "leaf", "altered")), strict=True):
            places, runs, i = [], [], idx
            for begin, end, at in lower:
                run = i // FAN * FAN
                runs.append([written[at[k - begin]] for k in range(run, min(run + FAN, end)) if k != i])
                places.append(i - run)
                i //= FAN
            rows.append(sink.row(key, own, now, subroot, root, places + rest_places, runs + rest_runs))
        columns = zip(*rows, strict=True)
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, sink.types, strict=True)], names=names)

    return extract


def proofs(tables: dict[str, DataFrame], sink=Digests) -> DataFrame:
    """The proof of every leaf of a manifest, in the form of ``sink``. A range's leaves, its
    stretch of the log and the siblings above it meet in one group of bounded size."""
    leaves, log, trees, top_log = (tables[k] for k in ("leaves", "log", "trees", "top_log"))
    asked = leaves.withColumn("range", F.expr(f"idx div {RANGE}"))
    ranges = leaves.filter(f"idx % {RANGE} = 0").select("tree", F.expr(f"idx div {RANGE}").alias("range"), "n")
    inner = log.filter(f"level <= {TIER}").select("tree", F.expr(f"idx div CAST(power({FAN}, {TIER} - level) AS LONG)").alias("range"), F.lit(0).alias("kind"), "level", "idx", "address", "digest")
    above = siblings(ranges.select("range", "tree", "n", F.col("range").alias("idx")), log, TIER)
    above = above.select("tree", "range", F.lit(1).alias("kind"), "level", F.col("sib").alias("idx"), F.lit(None).cast("long").alias("address"), "digest")
    # What all ranges of a tree share: its place among the trees, and the root (one row).
    root = top_log.groupBy().agg(F.max_by("digest", "address").alias("digest"))
    shared = trees.select("tree", F.lit(2).alias("kind"), F.lit(0).alias("level"), "idx", F.col("trees").alias("address"), F.col("subroot").alias("digest"))
    shared = shared.unionAll(beside(trees.select("tree"), root).select("tree", F.lit(3), F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("long"), "digest"))
    around = siblings(trees.select(F.col("tree").alias("of"), F.lit(TOP).alias("tree"), F.col("trees").alias("n"), "idx"), top_log)
    shared = shared.unionAll(around.select("of", F.lit(4), "level", "sib", F.lit(None).cast("long"), "digest"))
    shared = ranges.select("tree", "range").join(shared, "tree").select("tree", "range", "kind", "level", "idx", "address", "digest")
    stretch = inner.unionAll(above).unionAll(shared)
    return stretch.groupBy("tree", "range").cogroup(asked.groupBy("tree", "range")).applyInArrow(_extracted(sink), sink.shape)


def tampered(docs: DataFrame, where: Column, text: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``docs`` with the digest (``_altered``) that rows chosen by ``where`` have once the
    letters A-Z of their text are lower-cased."""
    upper = "".join(chr(c) for c in range(65, 91))
    lower = F.translate(F.col(text), upper, upper.lower())
    return docs.withColumn("_altered", F.when(where, leaf([lower if c == text else F.col(c) for c in fields])))
