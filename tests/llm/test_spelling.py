import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktrail.llm import bitmap, spelling
from worktrail.llm.spelling import near_pairs, one_edit, variants


def lower(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    words = {w: c for w, c in n.items() if c >= 2}
    out, form = {}, {}
    for w, c in words.items():
        around = [x for x in words if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * c else None
        out[w] = len(around)
    rows = []
    for w, c in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, c, out[w], words[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edge_cases_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["understanding", "Éléphantes", "ÀÉÎÕÜßÿ", "aaaaaaa", "aaaaaaaa", "abcdefg", "STRASSE", "straßen", "naïveté×÷"]
    rows = [(k, " ".join(rng.choices(words, k=40)) + rng.choice([" ", "中", "Ā", "1_"])) for k in range(60)]
    rows += [(k, rng.choice(words)[:-1] + " " + "understandin" + "x" * rng.randrange(3)) for k in range(60, 90)]
    rows += [(None, "nobody-knows this_vocabulary this_vocabulary"), (91, None), (92, ""), (93, "z" * 30000 + " " + "z" * 30000), (94, "zz\x00letters letters\x00"), (1, "abcdefg " * 500)]
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    assert got(variants(docs)) == brute(rows)
    assert variants(docs.limit(0)).count() == 0


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(variants(docs)) == brute(rows)


def test_long_texts_are_read_in_stretches(monkeypatch):
    data = np.frombuffer(("Alpha betaé " * 50 + "q" * 90 + " end").encode(), dtype=np.uint8)
    cuts = list(spelling._stretches(data, 0, len(data), 40))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    words = [w for s, e in cuts for w in re.findall(rb"[^ ]+", data[s:e].tobytes())]
    assert words == data.tobytes().split()


def test_neighbourhoods_hold_all_that_one_edit_makes(spark):
    """Every word one edit away has its reduced key among the neighbourhood's keys."""
    rng = random.Random(1)
    for word in ("reduced", "aaaaaaa", "éàüßøñç", "alphabets"):
        other = set()
        for i in range(len(word) + 1):
            for c in "abcxyzéÿ":
                other |= {word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]}
            other.add(word[:i] + word[i + 1 :])
        _, own = next(iter(spelling._by_length(pa.array([word]))))
        keys = set(spelling._neighbourhood(own)[0].tolist())
        for x in rng.sample(sorted(other), 40):
            _, symbols = next(iter(spelling._by_length(pa.array([x]))))
            assert spelling._keys(symbols)[0].item() in keys


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    """With a bitmap of few bits, where nearly every neighbour passes, pairs are the same."""
    rng = random.Random(8)
    words = {"".join(rng.choices("abc", k=rng.randint(7, 9))) for _ in range(400)}
    vocab = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if near(a, b))
    monkeypatch.setattr(bitmap, "BITS", 10)
    monkeypatch.setattr(bitmap, "SEGMENT", 9)
    assert sorted((r.word, r.other) for r in near_pairs(vocab).collect()) == want


def test_one_edit_counts_code_points(spark):
    rows = [("éa", "a"), ("éa", "ea"), ("éa", "ée"), ("éa", "éa"), ("éa", "aé"), ("abc", "a")]
    said = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(one_edit(F.col("a"), F.col("b"))).collect()]
    assert said == [near(a, b) for a, b in rows]
