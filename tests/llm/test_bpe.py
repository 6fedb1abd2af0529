import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from worktrail.llm.bpe import Ids, decode, encode

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = ["", None, " ", "\n\n\n ", "a", "I'll we've they're 'r 're '", "<|endoftext|> is text", "naïve Ünïcode 数字 １２３ 😀😀", "a" * 3000, " " * 500 + "x", "word " * 900,
         "tail  ", "'r" * 700, "x1" * 800, "\t \r\n" * 400, "é" * 1500 + " 12" * 500]


def expected(rows):
    out = []
    for key, text in rows:
        ids = WHOLE.encode_ordinary(text or "")
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        out.append((key, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 1 << 9), (64, 16), (17, 9), (40, 200)])
def test_chunked_encoding_equals_the_library(spark, chunk, overlap):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[12]), (3, TEXTS[12]), (None, TEXTS[7]), (None, "other " * 50)]
    docs = spark.createDataFrame([(k, t, 5, "x") for k, t in rows], "doc_id long, text string, n_tokens int, digest string")
    out = encode(docs, PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == expected(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for chunk in (1 << 15, 700):
        assert sorted(map(tuple, encode(docs, PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=64).collect()), key=str) == expected(rows)


def test_round_trip_of_ids(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = encode(docs, PATH, public_tokenizers.PATTERN, sink=Ids, chunk=100, overlap=20)
    back = {r.doc_id: bytes(r.raw).decode() for r in decode(ids, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
