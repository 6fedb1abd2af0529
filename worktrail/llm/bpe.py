"""Byte-level BPE encoding and decoding over overlapping chunks.

A text longer than one chunk is cut into chunks that overlap. Tasks pre-tokenise chunks
independently; where the boundaries of two neighbours meet inside their overlap they agree
from there on, because a match depends only on what follows it. The chunks are stitched at
that place, and a run that never meets is matched again over both chunks. Pieces are then
merged by rank one at a time, and decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.llm.words import plus, settle

#: Code points of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: A boundary depends on at most this many code points after it ("'re" is the longest).
LOOKAHEAD = 4
#: Pieces that a task remembers; beyond it, it starts afresh.
REMEMBERED = 1 << 18


class _Merged(dict):
    """piece -> its ids, filled on demand."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = tuple(self.merge(piece))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Pre-tokeniser pattern and merges of one vocabulary (lines of base64 token and rank)."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        # Pieces come cut already: the merger takes whatever it is given as one piece.
        merger = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern, regex.V0)
        self.merged = _Merged(merger.encode_ordinary)
        self.raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.decimal = [str(i).encode() for i in range(len(self.raw))]

    def cut(self, text: str) -> list[str]:
        return self.pieces.findall(text)

    def encode(self, pieces: Iterable[str]) -> list[int]:
        return list(chain.from_iterable(map(self.merged.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec per task process."""
    key = hash(vocabulary), pattern
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary, pattern)
    return _CODECS[key]


class Ids:
    """Result columns n_tokens and ids."""

    shape = "n_tokens long, ids array<int>"

    def __init__(self, _: Codec):
        self.ids: list[int] = []

    def add(self, ids: list[int]) -> None:
        self.ids += ids

    def row(self) -> tuple:
        return len(self.ids), self.ids


class Digests:
    """Result columns n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256
    (bytes that decoding the ids gives back), without holding a whole text."""

    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def __init__(self, codec: Codec):
        self.codec, self.n = codec, 0
        self.ids, self.raw = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int]) -> None:
        if ids:
            self.ids.update(b" " * (self.n > 0) + b" ".join(map(self.codec.decimal.__getitem__, ids)))
            self.raw.update(self.codec.decode(ids))
            self.n += len(ids)

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.raw.hexdigest()


class Tokens(Digests):
    """The columns of Digests, then the ids themselves."""

    shape = Digests.shape + ", ids array<int>"

    def __init__(self, codec: Codec):
        super().__init__(codec)
        self.all: list[int] = []

    def add(self, ids: list[int]) -> None:
        super().add(ids)
        self.all += ids

    def row(self) -> tuple:
        return *super().row(), self.all


class Chunk:
    """A stretch of text from ``start`` on, with the pieces found from its beginning."""

    def __init__(self, start: int, text: str, ends: list[int], sizes: list[int], ids: list[int]):
        self.start, self.text, self.ends, self.sizes, self.ids = start, text, ends, sizes, ids

    @classmethod
    def of(cls, codec: Codec, start: int, text: str) -> Chunk:
        pieces = codec.cut(text)
        at, ends = start, []
        for p in pieces:
            at += len(p)
            ends.append(at)
        merged = [codec.merged[p] for p in pieces]
        return cls(start, text, ends, [len(m) for m in merged], list(chain.from_iterable(merged)))

    def take(self, to: int) -> list[int]:
        """Remove the pieces that end at ``to`` or before; return their ids."""
        from bisect import bisect_right

        n = bisect_right(self.ends, to)
        size = sum(self.sizes[:n])
        out, self.ids = self.ids[:size], self.ids[size:]
        self.ends, self.sizes = self.ends[n:], self.sizes[n:]
        return out

    def trusted(self) -> int:
        return self.start + len(self.text) - LOOKAHEAD


class Stitcher:
    """Joins the chunks of one text, given in order, and hands their ids to a sink."""

    def __init__(self, codec: Codec, sink):
        self.codec, self.sink = codec, sink
        self.now: Chunk | None = None
        self.begin = 0  # from where ``now`` still has to be handed on
        self.retry = 0

    def add(self, chunk: Chunk) -> None:
        now = self.now
        if now is None:
            self.now, self.begin = chunk, chunk.start
            return
        meet = set(chunk.ends) | {chunk.start}
        at = next((e for e in [self.begin, *now.ends] if chunk.start <= e <= now.trusted() and e in meet), None)
        if at is not None:
            self.sink.add(now.take(at))
            chunk.take(at)
            self.now, self.begin = chunk, at
            return
        # No common boundary: match again from the last one that is sure, over both texts.
        sure = max((e for e in now.ends if e <= now.trusted()), default=self.begin)
        self.sink.add(now.take(sure))
        rest = now.text[sure - now.start :] + chunk.text[now.start + len(now.text) - chunk.start :]
        if len(rest) >= self.retry:
            # A run without boundaries is matched again only when it has doubled.
            self.retry = 2 * len(rest) if sure == self.begin else 0
            self.now = Chunk.of(self.codec, sure, rest)
        else:
            self.now = Chunk(sure, rest, [], [], [])
        self.begin = sure

    def finish(self) -> tuple:
        if self.now is not None:
            if not self.now.ends and self.begin < self.now.start + len(self.now.text):
                self.now = Chunk.of(self.codec, self.begin, self.now.text[self.begin - self.now.start :])
            self.sink.add(self.now.ids)
        return self.sink.row()


def _table(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, key: str = "doc_id", text: str = "text", sink: type = Digests, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, columns of ``sink``) for every row of ``docs``, each text encoded whole without
    special tokens.

    Null texts are empty: no tokens. Rows that repeat a key, or a key and a text, give a row
    each. Other columns are neither read nor returned. The vocabulary is a file beside the
    driver; its bytes travel to the tasks and are as large as the file.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    settle(spark)
    with open(vocabulary_path, "rb") as file:
        shared: Broadcast[bytes] = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = plus(rows.select("key").schema, sink.shape)
    shape = to_arrow_schema(out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value, pattern)
        for batch in batches:
            done = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                to = sink(tool)
                to.add(tool.encode(tool.cut(t.as_py())))
                done.append((k, *to.row()))
            yield _table(done, shape)

    cut_out = plus(rows.select("key").schema, "digest string, no int, text string")
    cut_shape = to_arrow_schema(cut_out)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, d, t in zip(*(batch.column(i) for i in range(3)), strict=True):
                body, k, d = t.as_py(), k.as_py(), d.as_py()
                for at in range(0, len(body), 256 * chunk):
                    starts = range(at, min(len(body), at + 256 * chunk), chunk)
                    yield _table([(k, d, s // chunk, body[s : s + chunk + overlap]) for s in starts], cut_shape)

    found_out = plus(cut_out, "ends array<int>, sizes array<int>, ids array<int>")
    found_shape = to_arrow_schema(found_out)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value, pattern)
        for batch in batches:
            for row in range(batch.num_rows):
                k, d, no, t = (batch.column(i)[row].as_py() for i in range(4))
                c = Chunk.of(tool, 0, t)
                yield _table([(k, d, no, t, c.ends, c.sizes, c.ids)], found_shape)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks come sorted by text and number; equal rows repeat each chunk."""
        tool = codec(shared.value, pattern)
        now, copies, last, join = None, 0, -1, None
        for batch in batches:
            for row in range(batch.num_rows):
                k, d, no = (batch.column(i)[row].as_py() for i in range(3))
                if (k, d) != now:
                    if now is not None:
                        yield _table([(now[0], *join.finish())] * copies, shape)
                    now, copies, last, join = (k, d), 0, -1, Stitcher(tool, sink(tool))
                copies += no == 0
                if no == last:
                    continue
                last = no
                t, ends, sizes, ids = (batch.column(i)[row].as_py() for i in range(3, 7))
                join.add(Chunk(no * chunk, t, [e + no * chunk for e in ends], sizes, ids))
        if now is not None:
            yield _table([(now[0], *join.finish())] * copies, shape)

    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, out)
    long = rows.filter(F.length("text") > chunk).select("key", F.md5("text").alias("digest"), "text").mapInArrow(chunks, cut_out)
    pieces = long.repartition("key", "digest", "no").mapInArrow(found, found_out)
    in_order = pieces.repartition("key", "digest").sortWithinPartitions("key", "digest", "no")
    done = short.unionAll(in_order.mapInArrow(stitch, out))
    return done.withColumnRenamed("key", key)


def decode(tokens: DataFrame, vocabulary_path: str, pattern: str, ids: str = "ids", to: str = "raw") -> DataFrame:
    """``tokens`` with the bytes of their ids in ``to`` (binary); null ids give null."""
    spark = tokens.sparkSession
    settle(spark)
    with open(vocabulary_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rest = [c for c in tokens.columns if c != to]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value, pattern)
        for batch in batches:
            raw = [None if x is None else tool.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*rest, to])

    return tokens.select(*rest).mapInArrow(tasks, plus(tokens.select(*rest).schema, f"{to} binary"))
