import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from worktrail.llm import simhash
from worktrail.llm.components import components


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest position that each distinct print reaches through links of at most 3 bits."""
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    order = sorted(set(prints))
    for i, p in enumerate(order):
        for q in order[:i]:
            if (p ^ q).bit_count() <= 3:
                root[top(p)] = top(q)
    return {p: top(p) for p in order}


def expected(rows):
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    low = {}
    for (k, _), p in zip(rows, prints, strict=True):
        if k is not None:
            low[roots[p]] = min(low.get(roots[p], k), k)
    return sorted(((k, f"{p:016x}", low.get(roots[p])) for (k, _), p in zip(rows, prints, strict=True)), key=str)


EDGE = [(1, "One two THREE four"), (2, "one  two\tthree\nfour"), (3, None), (4, ""), (5, " \n"), (6, "alone"), (7, "É é"), (7, "another text under one key"),
        (7, "another text under one key"), (None, "one two three four"), (None, "nobody knows this text at all"), (8, "x " * 40000)]


def test_edge_cases_equal_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "a", "b") for k, t in EDGE], "doc_id long, text string, fingerprint string, component_id string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == expected(EDGE)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == expected(rows)


@pytest.mark.parametrize("leaf", [4, 256])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, leaf):
    """A hot block (one leading pattern for most prints), dense balls and far strangers."""
    import random

    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "FAN", 4)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(12):
        centre = (0xABCD << 48) | rng.getrandbits(48)
        for _ in range(60):
            p = centre
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    got = brute_components_of_links(prints, [(a % (1 << 64), b % (1 << 64)) for a, b in links])
    want = brute_components(prints)
    assert Counter(map(len, groups(got))) == Counter(map(len, groups(want))) and groups(got) == groups(want)
    assert all((a ^ b).bit_count() <= 64 for a, b in links)


def groups(roots):
    out = {}
    for p, r in roots.items():
        out.setdefault(r, set()).add(p)
    return sorted(map(sorted, out.values()))


def brute_components_of_links(prints, links):
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {p: top(p) for p in prints}


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 500), (None, 3), (3, None), (1, 2), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 500: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(EDGE)], "doc_id long, text string, n_chars long")
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.filter(F.col("doc_id").isNotNull()).collect()) == sorted(
        [(1, EDGE[0][1]), (3, None), (6, "alone"), (7, "É é"), (7, "another text under one key"), (8, "x " * 40000)], key=str)
    assert [r.text for r in kept.filter("doc_id IS NULL").collect()] == ["nobody knows this text at all"]
