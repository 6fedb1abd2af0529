import random
import re

from worktrail.llm import decontam
from worktrail.llm.decontam import contaminated, without_items

SF = "/root/testdata/sf0.01"


def words(text):
    return [w.lower() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


def distance(item, text):
    """Least word edits between the item and any stretch of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def edited(rng, text, edits, vocabulary):
    w = text.split()
    for _ in range(edits):
        kind, p = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[p] = rng.choice(vocabulary)
        elif kind == 1:
            w.insert(p, rng.choice(vocabulary))
        else:
            w.pop(p)
    return " ".join(w)


def test_recall_and_exact_distances(spark):
    """Planted items with up to a fifth of their words edited, among ordinary text."""
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    vocabulary = " ".join(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()).split()
    rows = []
    for i, text in items:
        for part in (0.0, 0.1, 0.2):
            noise = [[rng.choice(vocabulary) for _ in range(rng.randrange(90))] for _ in range(2)]
            body = edited(rng, text.upper() if rng.random() < 0.3 else text.replace(" ", ", "), int(part * len(words(text))), vocabulary)
            rows.append((len(rows), " ".join(noise[0]) + " " + body + " " + " ".join(noise[1])))
    out = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "item_id", "words", "distance", "similarity"]
    got = {(r.doc_id, r.item_id): r.distance for r in out.collect()}
    want = {}
    for d, text in rows:
        for i, item in items:
            w = words(item)
            if i in (d // 3, (d // 3 + 1) % len(items), (d // 3 + 7) % len(items)):
                e = distance(w, words(text))
                if e <= 0.2 * len(w):
                    want[d, i] = e
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) and len(want) >= 3 * len(items) - 6
    assert all(want[k] <= e for k, e in got.items()) and sum(want[k] == e for k, e in got.items()) >= 0.98 * len(got)
    exact = {k for k, e in want.items() if e == 0}
    assert len(exact) >= len(items) - 3 and exact <= set(got) and all(got[k] == 0 for k in exact)


def test_documents_hold_their_verbatim_items(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = [(r.item_id, " " + " ".join(words(r.text)) + " ") for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in flat if t in " " + " ".join(words(r.text)) + " "}
    got = {(r.doc_id, r.item_id): r.distance for r in contaminated(docs, items).collect()}
    assert want and want <= set(got) and {k for k, e in got.items() if e == 0} == want
    kept = without_items(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 4)  # several blocks
    items = spark.createDataFrame([(1, "one"), (2, "two words"), (3, "three words here ok"), (3, "three words here ok"), (4, None), (5, " ,. "), (None, "x"), (6, "a b c d e f g h i")], "item_id long, text string")
    texts = [None, "", "!!", "ONE", "xx two, WORDS", "so three words here ok then", "a b c d q f g h i", "a b c d e f g h", "one " * 5000, "a b c", "one"]
    docs = spark.createDataFrame([(i, t, 9, 0.1) for i, t in enumerate(texts)] + [(10, "one", 9, 0.1), (None, "one", 9, 0.1)], "doc_id long, text string, item_id int, distance double")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in contaminated(docs, items).collect()), key=str)
    want = [(3, 1, 0), (4, 2, 0), (5, 3, 0), (6, 6, 1), (7, 6, 1), (8, 1, 0), (10, 1, 0), (10, 1, 0), (None, 1, 0)]
    assert got == sorted(want, key=str)
    assert sorted(r.doc_id for r in without_items(docs, items).collect()) == [0, 1, 2, 9]
    empty = items.limit(0)
    assert contaminated(docs, empty).count() == 0 and contaminated(docs, empty).columns == ["doc_id", "item_id", "words", "distance", "similarity"]
    assert without_items(docs, empty).count() == docs.count() and contaminated(docs.limit(0), items).count() == 0
