import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktrail.llm.merkle import Proofs, address, fold, manifest, proofs, sizes, tampered


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """(top, siblings and place of each leaf by level)."""
    paths = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for leaf, i in enumerate(at):
            run = i // 8 * 8
            paths[leaf].append((i - run, digests[run:i] + digests[i + 1 : run + 8]))
        digests = [sha("".join(digests[k : k + 8])) for k in range(0, len(digests), 8)]
        at = [i // 8 for i in at]
    return digests[0], paths


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    tops, inner = [], []
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        top, paths = climb([x[2] for x in trees[name]])
        tops.append(top)
        inner.append(paths)
    root, outer = climb(tops)
    out = []
    for k, name in enumerate(names):
        for (_, _, leaf, row), path in zip(trees[name], inner[k], strict=True):
            whole = path + outer[k]
            own = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                own = leaf_of((*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])))
            for place, run in whole:
                own = sha("".join([*run[:place], own, *run[place:]]))
            out.append((row[0], leaf, tops[k], root, sha("".join(d for _, run in whole for d in run)), own, own == root))
    return sorted(out, key=str)


def table(spark, rows):
    shape = "doc_id long, source string, lang string, n_chars long, text string, tree string, root string, idx int"
    return spark.createDataFrame([(*r, "x", "y", 5) for r in rows], shape)


def got(docs):
    docs = tampered(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return sorted((tuple(r) for r in proofs(manifest(docs)).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 513, 4105])
def test_addresses_are_the_completion_order(n):
    up = sizes(n)
    log, done = [], [0] * len(up)
    for _ in range(n):
        log.append((0, done[0]))
        done[0] += 1
        for level in range(1, len(up)):
            last = done[level - 1] == up[level - 1]
            if done[level] < up[level] and (done[level - 1] == 8 * (done[level] + 1) or last):
                log.append((level, done[level]))
                done[level] += 1
            else:
                break
    assert len(log) == sum(up)
    where = {node: place for place, node in enumerate(log)}
    for level, many in enumerate(up):
        assert address(level, np.arange(many), n).tolist() == [where[level, i] for i in range(many)]


def test_edge_cases_equal_brute_force(spark):
    rows = [(1, "a", "en", 3, "One"), (1, "a", "en", 3, "One"), (1, "b", "en", None, None), (None, "c", None, 0, ""), (None, None, None, None, None), (-7, "d", "", 1, "É"),
            (12, "e", "-", 2, "Ab"), (2, "f", "zh", 9, "X" * 200000), (3, "f", "ü", 9, "q"), (4, "f", "z", 9, "Q")]
    assert got(table(spark, rows)) == brute(rows)
    lone = [(5, "a", "en", 1, "Zebra")]
    assert got(table(spark, lone)) == brute(lone)
    assert got(table(spark, rows).limit(0)) == []


def test_many_trees_and_a_deep_one(spark):
    rng = random.Random(4)
    rows = [(k, "s", "en", 1, f"T{k}") for k in rng.sample(range(-9000, 90000), 1300)]
    rows += [(k, "s", f"l{rng.randrange(30)}", 1, f"T{rng.randrange(5)}") for k in range(300)]
    docs = table(spark, rows).repartition(4)
    assert got(docs) == brute(rows)
    one = proofs(manifest(docs), Proofs).filter("key = 17").first()
    assert fold(one.leaf, one.places, one.siblings) == one.root
    assert fold(one.leaf[::-1], one.places, one.siblings) != one.root


def test_the_log_is_whole(spark):
    rows = [(k, "s", "en", 1, "t") for k in range(1100)]
    log = manifest(table(spark, rows))["log"].collect()
    assert sorted(r.address for r in log) == list(range(sum(sizes(1100))))
