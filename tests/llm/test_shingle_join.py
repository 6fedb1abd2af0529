import random
import re

import pytest

from worktrail.llm import shingle_join
from worktrail.llm.shingle_join import similar_documents


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[top(i)] = min(low.get(top(i), k), k)
    return sorted(((k, len(sets[i]), low.get(top(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


EDGE = [(1, "One two THREE four"), (2, "one  two\tthree\nfour"), (3, None), (4, ""), (5, " \n"), (6, "alone"), (7, "É é"), (7, "another text under one key here"),
        (7, "another text under one key here"), (None, "one two three four"), (None, "nobody knows this text at all today"), (8, "x " * 40000), (9, "x x x x x x"),
        (10, " ".join(f"w{i}" for i in range(20000))), (11, " ".join(f"w{i}" for i in range(1, 20001))), (12, None)]


def test_edge_cases_equal_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t in EDGE], "doc_id long, text string, component_id string, n_shingles int")
    assert got(similar_documents(docs)) == brute(EDGE)
    assert similar_documents(docs.limit(0)).count() == 0


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(similar_documents(docs)) == brute(rows)


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("pairs", [0, 4])
def test_families_about_the_threshold(spark, monkeypatch, pairs):
    """Large groups of near copies, some linked only through others, a passage that half of the
    documents hold, and exact copies; with and without further rounds of leaders."""
    monkeypatch.setattr(shingle_join, "PAIRS", pairs)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(rng.randint(60, 160))]
        texts += [family(rng, base, rng.randint(0, 6)) for _ in range(40)]
    texts += [" ".join(passage + [f"u{k}v{i}" for i in range(rng.randint(1, 90))]) for k in range(300)]
    texts += [texts[5]] * 30
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[s : s + 200]) for s in range(0, 200, 11)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(similar_documents(docs)) == brute(rows)


def test_common_tokens_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    rows = [(k, " ".join(passage + [f"u{rng.randrange(40)}" for _ in range(rng.randint(0, 12))])) for k in range(400)]
    monkeypatch.setattr(shingle_join, "LEAST", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    want = brute(rows)
    assert got(similar_documents(docs)) == want
    monkeypatch.setattr(shingle_join, "LEAST", 10**9)
    assert got(similar_documents(docs)) == want


def test_namesakes_are_told_apart(spark, monkeypatch):
    """With class names of a single byte, many sets share one; the components stay the same."""
    rng = random.Random(6)
    texts = [family(rng, [f"f{f}w{i}" for i in range(50)], rng.randint(0, 3)) for f in range(60) for _ in range(8)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(shingle_join, "CLASS_BYTES", 1)
    assert got(similar_documents(docs)) == brute(rows)
