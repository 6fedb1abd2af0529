"""Exact Jaccard join of documents over word shingles, filtered by several global token orders.

Sorted by any one order of all tokens, two sets with enough in common share a token among the
first few of each (its prefix). Several orders give several such conditions, and a pair has to
meet all of them before its sets are compared:

* order 1 is by rarity (tokens of one document first, then by document count): its prefixes
  form the index in which documents meet;
* order 2 is by the magnitude of the document count, order 3 by a hash alone, both after the
  tokens of one document: their prefixes are compared for the pairs that order 1 offers.

A third of each set comes first: the tokens of lowest hash, in which two similar sets share a
known number too. Only sets that share that many there with others at all go on, so few sets
have all their tokens counted and sorted by rarity.

Equal sets are one class and meet as one. Classes need their components, not all their links:
in each bucket of the index, members outside the bucket's largest component so far are compared
with one member of it, so a large group of near copies becomes one component in linear work.
What still shares a bucket across components is compared pair by pair, whatever there is.

Tokens that a large share of all documents hold are found while sets are built; their rows need
no counting, they come last in every prefix by rarity, so no task counts a hot token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.llm.bitmap import bitmap, may_hold
from worktrail.llm.components import components
from worktrail.llm.words import LOWER, gathered, mix, settle, slices
from worktrail.session import pinned

WORDS = 5
#: A token is common if the parts of the table in which one in LOCAL documents holds it (and
#: LEAST do) have it in one of GLOBAL documents of the whole table. This places work and breaks
#: ties of rarity; no result depends on it. At most GLOBAL times the mean set are common.
LOCAL, LEAST, GLOBAL = 64, 8, 200
#: Rounds with leaders end where the pairs left are few per index row, or where a round left more
#: than this share of them.
PAIRS, SHRINKS = 4, 0.9
#: Pairs and sets of a task that verifies, about, where there are as many.
TASK_PAIRS, TASK_SETS = 500, 2000
_COMMON = 1 << 40
#: Bytes of the name of a class; two sets may share one.
CLASS_BYTES = 8


def _sets(words) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; shorter texts are one shingle."""
    lower = LOWER[words.data]
    hashes = words.hashes(lower)
    grams = np.empty(0, dtype=np.uint64)
    many = len(hashes) - WORDS + 1
    if many > 0:
        grams = np.full(many, WORDS, dtype=np.uint64)
        for k in range(WORDS):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + many])
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = last - first
        if n >= WORDS:
            yield np.unique(grams[first : last - WORDS + 1])
        elif n:
            one = np.full(1, n, dtype=np.uint64)
            for k in range(first, last):
                one = mix(one * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + 1])
            yield one
        else:
            yield np.empty(0, dtype=np.uint64)


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if a is None else len(a) for a in arrays], dtype=np.int64)
    flat = [a for a in arrays if a is not None]
    values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    missing = pa.array([a is None for a in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=missing)


def _sig(s: np.ndarray) -> bytes | None:
    return hashlib.md5(s.tobytes()).digest() if len(s) else None


def _class(sigs: list[bytes | None]) -> pa.Array:
    """A 64-bit name of each set. Two sets of one name are told apart by their ``sig``."""
    return pa.array([None if s is None else int.from_bytes(s[:CLASS_BYTES], "big", signed=True) for s in sigs], pa.int64())


def _first(size: np.ndarray) -> np.ndarray:
    """Tokens of lowest hash that sets of a size show first."""
    return np.minimum(size, 2 * (size // 5 + 1))


_DOCS = "key long, n long, sig binary, class long, tokens array<long>, counts array<long>"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document. A last row (n = -1) has the tokens that many documents of some slice
    hold, with their counts."""
    common: dict[int, int] = {}
    names = ["key", "n", "sig", "class", "tokens", "counts"]
    for batch in batches:
        for part, words in slices(batch):
            sets = list(_sets(words))
            sigs = [_sig(s) for s in sets]
            distinct = list(dict(zip(sigs, sets, strict=True)).values())
            if len(distinct) >= LEAST:
                token, count = np.unique(np.concatenate(distinct), return_counts=True)
                often = count >= max(LEAST, len(distinct) / LOCAL)
                for t, c in zip(token[often].tolist(), count[often].tolist(), strict=True):
                    common[t] = common.get(t, 0) + c
            none = pa.nulls(part.num_rows, pa.list_(pa.int64()))
            columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), _class(sigs), none, none]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    if common:
        tokens, counts = np.array(list(common), dtype=np.uint64), np.array(list(common.values()), dtype=np.int64)
        last = [pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), _lists([tokens]), _lists([counts])]
        yield pa.RecordBatch.from_arrays(last, names=names)


def _common_tokens(rows: DataFrame) -> np.ndarray:
    """Tokens of a large share of all documents, rarest first: at most GLOBAL times the mean set."""
    docs = rows.filter("n > 0").count()
    found = rows.filter("n = -1").select(F.explode(F.arrays_zip("tokens", "counts")).alias("t")).groupBy("t.tokens").agg(F.sum("t.counts").alias("held"))
    listed = found.filter(F.col("held") * GLOBAL >= docs).orderBy("held", "tokens").select("tokens").toPandas()
    return listed["tokens"].to_numpy(dtype=np.int64)


def _place(listed: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Place of each token in a sorted array, -1 where it isn't there."""
    if not len(listed):
        return np.full(len(tokens), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)
    return np.where(listed[at] == tokens, at, -1)


_ROWS = "h long, id long, held long"
_ROW_NAMES = ["h", "id", "held"]


def _showing(shared):
    """The first tokens of each set (once a task), a row each; common ones only as a number."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, _ = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            for _, words in slices(batch):
                sets, names = [], []
                for s in _sets(words):
                    sig = _sig(s)
                    if sig is not None and sig not in seen:
                        seen.add(sig)
                        sets.append(s[: int(_first(np.int64(len(s))))])
                        names.append(sig)
                if not sets:
                    continue
                name = _class(names).to_numpy()
                token = np.concatenate(sets).view(np.int64)
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                rare = _place(listed, token) < 0
                often = np.bincount(owner[~rare], minlength=len(sets))
                some = np.flatnonzero(often)
                columns = [
                    pa.array(np.concatenate([token[rare], name[some]])),
                    pa.array(np.concatenate([name[owner[rare]], name[some]])),
                    pa.concat_arrays([pa.nulls(int(rare.sum()), pa.int64()), pa.array(often[some].astype(np.int64))]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_ROW_NAMES)

    return tasks


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """Of rows sorted by token and id: (token, id, number of ids of the token), repeated rows
    once, for whole tokens; and the rows that bring their number along."""
    held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def counted(token: np.ndarray, who: np.ndarray):
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])
        token, who = token[new], who[new]
        begins = np.ones(len(token), dtype=bool)
        begins[1:] = token[1:] != token[:-1]
        first = np.flatnonzero(begins)
        return token, who, np.diff(np.append(first, len(token)))[np.cumsum(begins) - 1] if len(token) else first

    known = None
    for table in gathered(batches):
        bare = table.column("held").combine_chunks().is_null()
        known = table.filter(pc.invert(bare))
        table = table.filter(bare)
        token = np.concatenate([held[0], table.column("h").to_numpy()])
        who = np.concatenate([held[1], table.column("id").to_numpy()])
        cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
        yield *counted(token[:cut], who[:cut]), known
        held = token[cut:], who[cut:]
    if known is not None:
        yield *counted(*held), known.slice(0, 0)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, held): how many of a set's tokens other sets hold too, in parts."""
    for _, who, df, known in _runs(batches):
        ids, many = np.unique(who[df > 1], return_counts=True)
        columns = [pa.concat_arrays([pa.array(ids, pa.int64()), *known.column("id").chunks]), pa.concat_arrays([pa.array(many, pa.int64()), *known.column("held").chunks])]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "held"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, id, held) of tokens that two sets or more hold."""
    for token, who, df, known in _runs(batches):
        many = df > 1
        yield pa.RecordBatch.from_arrays([pa.array(token[many]), pa.array(who[many]), pa.array(df[many].astype(np.int64))], names=_ROW_NAMES)
        yield from known.select(_ROW_NAMES).to_batches()


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a token together and sorted; those that bring their number along lie anywhere."""
    return rows.repartition(F.when(F.col("held").isNull(), F.col("h")).otherwise(F.col("id"))).sortWithinPartitions("h", "id")


def _whole_sets(held):
    """(sig, tokens) of sets whose class a bitmap may hold, once a task."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        seen: set[bytes] = set()
        for batch in batches:
            for _, words in slices(batch):
                sets = [(sig, s) for s in _sets(words) if (sig := _sig(s)) is not None]
                if not sets:
                    continue
                wanted = may_hold(bits, _class([sig for sig, _ in sets]).to_numpy().view(np.uint64))
                kept = []
                for ok, (sig, s) in zip(wanted.tolist(), sets, strict=True):
                    if ok and sig not in seen:
                        seen.add(sig)
                        kept.append((sig, s))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([sig for sig, _ in kept], pa.binary()), _lists([s for _, s in kept])], names=["sig", "tokens"])

    return tasks


def _exploded(shared):
    """(h, id, held) of whole sets; a common token brings its place in the order by rarity."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, rank = shared.value
        for batch in batches:
            lists = batch.column(1)
            token, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            at = _place(listed, token)
            number = rank[at] + _COMMON if len(listed) else at
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(number, mask=at < 0)], names=_ROW_NAMES)

    return tasks


#: Tokens of a set of n that every set similar enough must share in part, in any order.
_PREFIX = "n div 5 + 1"
_MEMBERS = "rid long, n long, at long, tokens array<long>, marks binary, first array<long>"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set: the tokens that others share, sorted; what its prefixes hold of them by order 1
    (``first``), 2 and 3 (``marks``). Tokens of one set come first in every order; it has ``at``."""
    for batch in batches:
        n = batch.column(1).to_numpy()
        lists = batch.column(2)
        ends = lists.offsets.to_numpy()
        flat = lists.flatten()
        df, h = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        ends = ends - ends[0]
        tokens, marks, first, alone = [], [], [], []
        for k in range(len(n)):
            d, t = df[ends[k] : ends[k + 1]], h[ends[k] : ends[k + 1]]
            order = np.argsort(t, kind="stable")
            d, t = d[order], t[order]
            size = int(n[k])
            alone.append(size - len(t))
            take = size // 5 + 1 - alone[-1]
            u = t.view(np.uint64)
            mark = np.zeros(len(t), dtype=np.uint8)
            mark[np.lexsort((mix(u ^ np.uint64(0xD1B54A32D192ED03)), np.frexp(d.astype(np.float64))[1]))[:take]] |= 1
            mark[np.argsort(mix(u + np.uint64(0x632BE59BD9B4E019)), kind="stable")[:take]] |= 2
            tokens.append(u)
            marks.append(mark.tobytes())
            first.append(u[np.lexsort((t, d))[:take]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alone, pa.int64()), _lists(tokens), pa.array(marks, pa.binary()), _lists(first)], names=["rid", "n", "at", "tokens", "marks", "first"])


def _meet(x: np.ndarray, y: np.ndarray) -> int:
    """Values in both of two sorted arrays of distinct values."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose prefixes meet under orders 2 and 3 too, and whose whole sets then are similar
    enough: 100 * both >= 80 * either."""
    for batch in batches:
        sizes = (batch.column("x_n").to_numpy() + batch.column("y_n").to_numpy()).tolist()
        sides = []
        for side in "xy":
            lists = batch.column(f"{side}_tokens")
            sides.append((lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist(), batch.column(f"{side}_marks")))
        (x, i, x_marks), (y, j, y_marks) = sides
        keep = []
        for k, size in enumerate(sizes):
            a, b = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
            am, bm = (np.frombuffer(m[k].as_buffer(), dtype=np.uint8) for m in (x_marks, y_marks))
            passed = all(_meet(a[(am & order) > 0], b[(bm & order) > 0]) for order in (1, 2))
            keep.append(passed and 9 * _meet(a, b) >= 4 * size)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) that are similar. Both joins read one shuffle of the members."""
    sets = members.select("rid", "n", "tokens", "marks")
    left = pairs.join(sets, pairs["a"] == sets["rid"]).select("a", "b", *[F.col(c).alias(f"x_{c}") for c in ("n", "tokens", "marks")])
    both = left.join(sets, left["b"] == sets["rid"]).select(*left.columns, *[F.col(c).alias(f"y_{c}") for c in ("n", "tokens", "marks")])
    # Few pairs and sets are few tasks: partitions are put together, never dealt anew.
    tasks = max(pairs.count() // TASK_PAIRS, members.count() // TASK_SETS) + 1
    return both.coalesce(tasks).mapInArrow(_similar, "a long, b long")


#: Two sets of a bucket can still be similar enough, by their sizes and by what each holds from
#: the bucket's token on. At the first token that both hold, that is all they can share, so a
#: similar pair passes there.
_CAN_MEET = "5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) AND 9 * least(x.n - x.pos, y.n - y.pos) >= 4 * (x.n + y.n)"


def _links(members: DataFrame) -> DataFrame | None:
    """Links (a, b) of members that connect exactly what all similar pairs connect."""
    index = pinned(members.select(F.posexplode("first").alias("i", "h"), "rid", "n", "at").select("h", "rid", "n", (F.col("at") + F.col("i")).alias("pos")))
    rows = index.count()
    links = roots = None
    before, turn = 0, 0
    while True:
        now = index.withColumn("root", F.col("rid")) if roots is None else index.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        # The head of a component has the fewest tokens of its own: it is closest to the others.
        order = [F.col("pos") - turn % 2 * F.col("n"), F.xxhash64("rid", F.lit(turn))]
        parts = now.groupBy("h", "root").agg(F.count("*").alias("held"), F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "rid", "n", "pos")).alias("head"))
        lead = F.max(F.struct("held", (-F.col("root")).alias("low"), "root", "head")).alias("lead")
        buckets = parts.groupBy("h").agg(lead, F.count("*").alias("parts"), F.sum("held").alias("all"), F.sum(F.col("held") * F.col("held")).alias("same"))
        split = pinned(buckets.filter("parts > 1").select("h", "lead.root", "lead.head", (F.col("all") * F.col("all") - F.col("same")).alias("twice")))
        left_over, open_buckets = split.agg(F.sum("twice"), F.count("*")).first()
        if not open_buckets:
            return links
        last = turn > 0 and (left_over <= 2 * PAIRS * rows or turn > 1 and left_over > SHRINKS * before)
        before = left_over
        if last:
            kept = now.join(split.select("h"), "h", "left_semi")
            met = kept.alias("x").join(kept.alias("y"), F.expr(f"x.h = y.h AND x.rid < y.rid AND x.root != y.root AND {_CAN_MEET}"))
            pairs = met.selectExpr("x.rid AS a", "y.rid AS b").distinct()
        else:
            heads = split.select("h", F.col("root").alias("lead"), F.col("head").alias("y"))
            met = now.alias("x").join(heads, "h").filter(F.expr(f"root != lead AND {_CAN_MEET}")).select(F.col("rid").alias("x"), F.col("y.rid").alias("y"))
            # Of a member's leaders, the one that it shares most buckets with.
            often = met.groupBy("x", "y").count().groupBy("x").agg(F.max(F.struct("count", (-F.col("y")).alias("low"), "y")).alias("m"))
            pairs = often.select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()
        pairs = pinned(pairs)
        found = pinned(_verified(pairs, members))
        links = found if links is None else links.unionAll(found)
        if last:
            return links
        if not found.isEmpty():
            roots = pinned(components(links).select(F.col("node").alias("rid"), "root"))
        turn += 1


def _live(classes: DataFrame, docs: DataFrame, shared) -> DataFrame:
    """Classes whose first tokens others share to the extent that a similar set must; so
    must those that share their 64-bit name."""
    shown = docs.mapInArrow(_showing(shared), _ROWS)
    tally = _spread(shown).mapInArrow(_tallied, "id long, held long").groupBy("id").agg(F.sum("held").alias("held"))
    names = classes.groupBy("class").agg(F.count("*").alias("namesakes"))
    least = "(4 * n + 4) div 5"
    first = f"least({least}, 2 * ({least} div 5 + 1))"
    needed = F.expr(f"{first} - ({least} div 5 + 1) + 1")
    every = classes.join(names, "class").join(tally.withColumnRenamed("id", "class"), "class", "left")
    return every.filter((F.coalesce("held", F.lit(0)) >= needed) | (F.col("namesakes") > 1)).select("rid", "sig", "class", "n")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``n_shingles`` (distinct shingles of WORDS words; a shorter text
    is one) and ``component_id``, the smallest key that links of Jaccard 0.8 or more reach.

    Letters A-Z count in lower case. Null texts and texts without words have no shingles, are
    linked with nothing and name their own component. Equal sets are linked whatever their
    texts. Rows that repeat a key stay separate rows; a null key names no component unless all
    keys in it are null. Only key and text are read; empty tables give no rows.
    """
    spark = docs.sparkSession
    settle(spark)
    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = pinned(read.mapInArrow(_documents, _DOCS))
    # Numbered as they are written, so the numbers stay.
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("key").alias("low"), F.min("n").alias("n"), F.min("class").alias("class"))
    classes = pinned(classes.withColumn("rid", F.monotonically_increasing_id()))
    common = _common_tokens(rows)
    rank = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[rank], rank))
    live = pinned(_live(classes, read, shared))
    held = spark.sparkContext.broadcast(bitmap(live, "class"))
    whole = read.mapInArrow(_whole_sets(held), "sig binary, tokens array<long>").join(live.select("sig", "rid").hint("shuffle_hash"), "sig").select("rid", "tokens")
    ranked = _spread(whole.mapInArrow(_exploded(shared), _ROWS)).mapInArrow(_ranked, _ROWS)
    lists = ranked.groupBy("id").agg(F.collect_set(F.struct(F.col("held").alias("df"), "h")).alias("t")).withColumnRenamed("id", "rid")
    close = lists.join(live.select("rid", "n"), "rid").filter(f"n - size(t) < {_PREFIX}")
    members = pinned(close.select("rid", "n", "t").mapInArrow(_prefixes, _MEMBERS))
    links = _links(members)
    named = classes.select("sig", "low", "rid")
    if links is None:
        named = named.withColumn("component_id", F.col("low"))
    else:
        roots = components(links).select(F.col("node").alias("rid"), "root")
        named = pinned(named.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid")))
        lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
        named = named.join(lowest, "root")
    every = rows.filter("n >= 0").select("key", "n", "sig").join(named.select("sig", "component_id"), "sig", "left")
    return every.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
