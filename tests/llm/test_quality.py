import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from worktrail.llm import quality_trees
from worktrail.llm.docstats import COUNTS, FEATURES, counts_and_features
from worktrail.llm.quality_rff import classify, pool_adjacent
from worktrail.llm.quality_trees import judge, learn
from worktrail.llm.words import buffers, find

SF = "/root/testdata/sf0.01"
EDGE = ["", None, " \n\t", "one", "a b c a b c a b c", "x\nx\n\nx\ny z\ny z\r\n", "é # * $ % & | < >", "same same same same", "w " * 60, "\x1c\x85  b", "#" * 5000,
        " ".join(f"w{i}" for i in range(70)), "a\x0bb\x0cc"]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_counts_equal_brute_force(spark):
    texts = EDGE + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    counts, features = counts_and_features(find(*buffers(pa.array(texts))))
    assert list(zip(*(counts[c].tolist() for c in COUNTS), strict=True)) == [brute_counts(t) for t in texts]
    assert np.isfinite(features).all() and features.shape == (len(texts), len(FEATURES))


def test_rules_over_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = judge(docs, learn(docs, labels))
    assert out.columns == [*docs.columns, *COUNTS, "base_failed", "score", "kept"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, chars, symbols, dup, again = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in rows}
    told = [(by_id[x.doc_id].kept, x.quality) for x in labels.collect() if not by_id[x.doc_id].base_failed]
    assert np.mean([k == bool(q) for k, q in told]) > 0.97


def test_rules_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, 1.0, True) for i, t in enumerate(EDGE)] + [(1, "one", 2.0, False), (None, "one", 2.0, False)], "doc_id long, text string, score double, kept boolean")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    trees = learn(docs, none)
    out = judge(docs, trees)
    assert out.columns == ["doc_id", "text", *COUNTS, "base_failed", "score", "kept"]
    assert out.count() == len(EDGE) + 2
    assert {r.text for r in out.filter("kept").collect()} == {EDGE[11]}
    assert judge(docs.limit(0), trees).count() == 0
    some = spark.createDataFrame([(0, 1), (0, 1), (3, None), (None, 1), (4, 0), (77, 1)], "doc_id long, quality int")
    assert judge(docs, learn(docs, some)).count() == len(EDGE) + 2


def test_trees_obey_their_constraints(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(FEATURES)))
    falls = [i for i, f in enumerate(FEATURES) if f in quality_trees.FALLING]
    # The label rises with a constrained feature: the constraint must hold against the data.
    y = ((x[:, falls[0]] + 0.3 * x[:, 0] + 0.2 * rng.random(3000)) > 0.8).astype(float)
    trees = quality_trees.train(x, y)
    grid = np.linspace(-0.1, 1.1, 60)
    for f in falls:
        for base in x[:40]:
            row = np.repeat(base[None], len(grid), axis=0)
            row[:, f] = grid
            assert (np.diff(trees.score(row)) <= 1e-12).all()
    assert np.mean((trees.score(x) > 0.5) == (y > 0)) > 0.6
    # Scoring walks nodes as a loop over trees does.
    for row, got in zip(x[:20], trees.score(x[:20]), strict=True):
        total = trees.bias
        for root in trees.roots:
            at = root
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
            total += trees.value[at]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-12


def test_isotonic_pools():
    at, value = pool_adjacent(np.arange(6.0), np.array([0, 2, 1, 1, 4, 3.0]), np.array([4, 4, 4, 4, 4, 4.0]))
    assert (np.diff(value) >= 0).all() and value.tolist() == [0, 1 / 3, 0.875] and at.tolist() == [0, 2, 4.5]


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = classify(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[x.doc_id].score, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    assert np.mean([(s >= 0.5) == bool(q) for s, q in held]) > 0.95
    # Labels of held-out rows change nothing.
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: round(r.score, 9) for r in classify(docs, flipped).collect()} == {k: round(r.score, 9) for k, r in rows.items()}


@pytest.mark.parametrize("labelled", [[], [(0, 1), (2, 1)], [(0, 1), (0, 1), (3, None), (None, 1), (4, 0), (5, 0), (6, 1), (11, 1), (10, 0)]])
def test_classifier_edge_cases(spark, labelled):
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in enumerate(EDGE)] + [(3, "one", 1, 0.5), (None, "one", 1, 0.5)], "doc_id long, text string, x int, score double")
    out = classify(docs, spark.createDataFrame(labelled, "doc_id long, quality int")).collect()
    assert len(out) == len(EDGE) + 2 and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    assert classify(docs.limit(0), spark.createDataFrame(labelled, "doc_id long, quality int")).count() == 0


def test_rules_hold_for_labels_they_never_saw(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    trees = learn(docs, labels.filter("doc_id % 2 = 0"))
    by_id = {r.doc_id: r for r in judge(docs, trees).collect()}
    told = [(by_id[x.doc_id].kept, bool(x.quality)) for x in labels.filter("doc_id % 2 = 1 AND quality IS NOT NULL").collect() if not by_id[x.doc_id].base_failed]
    assert len(told) >= 100 and np.mean([k == q for k, q in told]) > 0.95
