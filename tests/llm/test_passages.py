import random

import numpy as np
import pyarrow as pa
import pytest

from worktrail.llm import passages as op
from worktrail.llm.passages import align, chains, minimisers, passages, stretches
from worktrail.llm.words import buffers, find


def brute_chain_score(at, of):
    """Best chain score by comparing every two anchors."""
    order = sorted(range(len(at)), key=lambda i: (at[i], of[i]))
    best = {}
    for i in order:
        best[i] = op.K + max([0.0] + [best[j] - op.GAP * (at[i] - at[j] + of[i] - of[j]) for j in best if at[j] < at[i] and of[j] < of[i]])
    return max(best.values())


def test_chains_are_the_best():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 25)
        at = np.array([rng.randrange(60) for _ in range(n)])
        of = np.array([rng.randrange(60) for _ in range(n)])
        found = chains(at, of)
        assert sorted(i for c in found for i in c) == list(range(n))
        assert all((np.diff(at[c]) > 0).all() and (np.diff(of[c]) > 0).all() for c in found)
        top = found[0]
        score = op.K * len(top) - op.GAP * (at[top[-1]] - at[top[0]] + of[top[-1]] - of[top[0]])
        assert abs(score - brute_chain_score(at, of)) < 1e-9


def test_every_long_verbatim_run_shares_a_seed():
    rng = random.Random(3)
    for _ in range(200):
        run = [str(rng.randrange(9)) if rng.random() < 0.2 else str(rng.random()) for _ in range(op.K + op.WINDOW - 1)]
        texts = [" ".join([str(rng.random()) for _ in range(rng.randrange(40))] + run + [str(rng.random()) for _ in range(rng.randrange(40))]) for _ in range(2)]
        owner, _, h = minimisers(find(*buffers(pa.array([*texts, None, "", "a b", " ".join("abcdef")]))))
        assert set(h[owner == 0]) & set(h[owner == 1]) and not (owner == 2).any() and not (owner == 4).any() and (owner == 5).sum() == 1


def test_alignment_and_stretches():
    a = np.arange(100)
    b = np.concatenate([np.arange(1000, 1010), a[20:50], [7], a[52:90], np.arange(2000, 2030)])
    pairs = align(a, b, np.array([(25, 15), (30, 20), (33, 23), (60, 49)])).tolist()
    same = np.array([i >= 0 and j >= 0 and a[i] == b[j] for i, j in pairs])
    assert [i for i, _ in pairs if i >= 0] == sorted(i for i, _ in pairs if i >= 0) and same.sum() == 68
    (x, y), = stretches(same)
    assert pairs[x] == [20, 10] and pairs[y - 1] == [89, 78]
    assert stretches(np.array([True] * 39)) == [] and stretches(np.zeros(0, dtype=bool)) == []


def vocabulary(rng, n=4000):
    return ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    """Passages in several documents each, verbatim or with a tenth of their words replaced."""
    rng = random.Random(8)
    words = vocabulary(rng)
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    kept = [prose(rng.randint(52, 90)) for _ in range(15)]
    rows, places = [], []
    for d in range(150):
        p = d % 15
        body = [rng.choice(words) if d % 2 and rng.random() < 0.1 else w for w in kept[p]]
        head = prose(rng.randrange(120))
        rows.append((d, " ".join(head) + "\n" + " ".join(w.title() if d % 4 == 2 else w for w in body) + "  " + " ".join(prose(rng.randrange(120)))))
        places.append((d, p, len(head), len(head) + len(body)))
    return rows, places


def test_planted_passages(spark, planted):
    rows, places = planted
    out = passages(spark.createDataFrame([(d, t, 1, 2.0) for d, t in rows], "doc_id long, text string, source int, id double"))
    assert out.columns == ["doc_id", "source", "start", "end", "source_start", "source_end", "matched"]
    got = out.collect()
    texts = {d: t.lower().split() for d, t in rows}
    of = {d: p for d, p, _, _ in places}
    for r in got:
        assert r.source < r.doc_id and of[r.source] == of[r.doc_id] and r.end - r.start >= op.LEAST_WORDS
        assert 5 * r.matched >= 4 * max(r.end - r.start, r.source_end - r.source_start)
        if r.matched == r.end - r.start == r.source_end - r.source_start:
            assert texts[r.doc_id][r.start : r.end] == texts[r.source][r.source_start : r.source_end]
    covered = {d: set() for d, _ in rows}
    for r in got:
        covered[r.doc_id] |= set(range(r.start, r.end))
    later = [(d, p, s, e) for d, p, s, e in places if d >= 15]
    share = [len(covered[d] & set(range(s, e))) / (e - s) for d, p, s, e in later]
    assert np.mean([x >= 0.7 for x in share]) >= 0.95
    verbatim = [x for x, (d, p, _, _) in zip(share, later, strict=True) if d % 2 == 0 and p % 2 == 0]
    assert verbatim and min(verbatim) == 1.0
    assert sum(len(covered[d] - set(range(s, e))) for d, p, s, e in places) < 0.02 * sum(e - s for _, _, s, e in places)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, "x " + long + " y"), (2, "x " + long + " y"), (2, "other"), (None, long.upper()), (None, "q " + long), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(39))),
            (6, "same " * 500), (7, "same " * 500), (8, " ".join(["alone"] * 3))]
    got = {(r.doc_id, r.source, r.start, r.end) for r in passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 1, 1, 61), (None, 1, 0, 60), (None, 1, 1, 61), (7, 6, 0, 69)}
    assert passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_stretch(same):
    """Longest run of columns, its outer ones equal, of which at least 0.8 are equal."""
    runs = [(y - x, -x) for x in range(len(same)) for y in range(x + 1, len(same) + 1) if same[x] and same[y - 1] and 5 * sum(same[x:y]) >= 4 * (y - x)]
    n, x = max(runs, default=(0, 0))
    return (-x, n - x) if n >= op.LEAST_WORDS else None


def test_stretches_are_the_longest():
    rng = random.Random(5)
    for _ in range(150):
        share = rng.choice([0.75, 0.8, 0.85, 0.9])
        same = np.array([rng.random() < share for _ in range(rng.randint(30, 120))])
        got, best = stretches(same), brute_stretch(same.tolist())
        assert (best in got) if best else not got
        assert all(5 * same[x:y].sum() >= 4 * (y - x) >= 4 * op.LEAST_WORDS for x, y in got)


@pytest.mark.parametrize("share", [0.82, 0.85, 0.9])
def test_edited_passages_are_whole(share):
    """Passages of 50 to 60 words with words replaced at random places, from any run of five
    equal words in them: what is found is as long as the best of all stretches."""
    rng = random.Random(int(100 * share))
    cases = 0
    while cases < 60:
        n = rng.randint(50, 60)
        wrong = set(rng.sample(range(n), int((1 - share) * n + 1e-9)))
        seeds = [i for i in range(n - op.K + 1) if not wrong & set(range(i, i + op.K))]
        if not seeds:
            continue
        cases += 1
        head, seed = rng.randrange(30), rng.choice(seeds)
        a = np.concatenate([np.arange(500, 500 + head), np.arange(n), np.arange(600, 630)])
        b = np.concatenate([np.arange(700, 710), [800 + i if i in wrong else i for i in range(n)], np.arange(900, 940)])
        pairs = align(a, b, np.array([(head + seed, 10 + seed)]))
        same = np.array([i >= 0 and j >= 0 and a[i] == b[j] for i, j in pairs.tolist()])
        found = stretches(same, pairs[:, 0] >= 0)
        x, y = brute_stretch([i not in wrong for i in range(n)])
        assert op.alike(a, b) and max((pairs[q - 1, 0] + 1 - pairs[p, 0] for p, q in found), default=0) >= y - x


def test_passages_of_known_lines(spark):
    """Lines of a passage that stand singly in earlier documents don't hide the document that
    holds them together, nor do pairs of its lines."""
    rng = random.Random(6)
    words = vocabulary(rng)
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    lines = [prose(15) for _ in range(8)]
    rows = []
    for size in (1, 2):
        rows += [(len(rows) + x, " ".join(prose(50) + sum(lines[x : x + size], []) + prose(50))) for x in range(len(lines) + 1 - size)]
    n, whole = len(rows), sum(lines, [])
    rows += [(n, " ".join(prose(30) + whole + prose(30))), (n + 1, " ".join(prose(70) + whole + prose(20))), (n + 2, " ".join(whole[20:72]))]
    got = {(r.doc_id, r.source): (r.start, r.end) for r in passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(n + 1, n): (70, 190), (n + 2, n): (0, 52)}
