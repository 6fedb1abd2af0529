import random
from collections import Counter
from dataclasses import fields

import numpy as np
import pytest

from worktrail.llm import pseudo_lm as lm
from worktrail.llm.pseudo_lm import Net, score

SF = "/root/testdata/sf0.001"


def brute(net, ids):
    """Sum of conditional log probabilities, one word after the other."""
    total = 0.0
    for i, t in enumerate(ids):
        around = [ids[i + s] if 0 <= i + s < len(ids) else lm.WORDS for s in lm.AROUND]
        x = sum(net.embed[k][a] for k, a in enumerate(around)) + net.bias
        y = x + net.lift[t // lm.GROUPS]
        first = (x / (1 + abs(x))) @ net.group + net.group_bias
        second = (y / (1 + abs(y))) @ net.word + net.word_bias[t // lm.GROUPS]
        for logits, at in ((first, t // lm.GROUPS), (second, t % lm.GROUPS)):
            total += logits[at] - np.log(np.exp(logits.astype(float)).sum())
    return total


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    net = Net.fresh(rng.random(lm.WORDS) * 100)
    net = net.of(net.flat() + rng.normal(0, 0.05, net.flat().shape))
    target, around = rng.integers(0, lm.WORDS, 300).astype(np.int16), rng.integers(0, lm.WORDS + 1, (4, 300)).astype(np.int16)
    step = net.gradient(target, around)
    flat = net.flat().astype(np.float64)

    def loss(flat):
        net64 = net.of(flat)
        for f, part in zip(fields(net64), np.split(flat, np.cumsum([getattr(net, f.name).size for f in fields(net)])[:-1]), strict=True):
            setattr(net64, f.name, part.reshape(getattr(net, f.name).shape))
        return -net64.log_probs(target, around).astype(np.float64).mean()

    grad = step.flat()
    for i in np.argsort(-np.abs(grad))[:: len(grad) // 40][:20].tolist() + np.argsort(-np.abs(grad))[:10].tolist():
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - grad[i]) < 2e-4


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known, ids, counts = lm.vocabulary(docs, "text")
    table = lm.tokens(docs, known, ids, "doc_id", "text")
    words = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    flat = Counter(w.lower() if w.isascii() else w for ws in words.values() for w in ws)
    assert counts.sum() == sum(flat.values()) and counts[0] == max(flat.values())
    from worktrail.session import pinned

    net = lm.train(pinned(table), counts)
    got = {r.doc_id: r for r in score(docs).collect()}
    for r in table.limit(40).collect():
        ids = np.frombuffer(bytes(r.tokens), dtype=np.int16).tolist()
        assert len(ids) == len(words[r.key]) == got[r.key].n_tokens
        assert abs(brute(net, ids) - got[r.key].log_prob) < 2e-3 * max(1, len(ids))
    # Better than the unigram model that training starts from, and word order matters.
    before = Net.fresh(counts)
    everything = [np.frombuffer(bytes(r.tokens), dtype=np.int16) for r in table.collect()]
    start = after = 0.0
    for t in everything:
        ids, around, _ = lm._windows(__import__("pyarrow").array([t.tobytes()]))
        start += before.log_probs(ids, around).sum()
        after += net.log_probs(ids, around).sum()
    assert after > start + 0.02 * abs(start)


def test_model_learns_order(spark):
    """Pairs of words that always follow each other: shuffled texts score lower."""
    rng = random.Random(1)
    nouns = [f"n{i}" for i in range(30)]
    texts = [" ".join(f"{w} v{w}" for w in rng.choices(nouns, k=60)) for _ in range(300)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:20]]
    rows = spark.createDataFrame(list(enumerate(texts + mixed)), "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in score(rows).collect()}
    assert np.mean([got[i] for i in range(300)]) > np.mean([got[300 + i] for i in range(20)]) + 0.5


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "word", 1), (3, "word", 1), (None, "A word", 1), (4, "long " * 50000, 1)], "doc_id long, text string, n_tokens int")
    out = score(docs)
    assert out.columns == ["doc_id", "n_tokens", "log_prob", "mean_log_prob"]
    rows = out.collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (1, 0), (2, 0), (3, 1), (3, 1), (4, 50000)]
    assert all(np.isfinite(r.log_prob) and r.log_prob <= 0 and (r.n_tokens or r.log_prob == 0 == r.mean_log_prob) for r in rows)
    assert score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 5, 40, 300])
def test_averaging_tree(spark, parts):
    rng = np.random.default_rng(parts)
    w = rng.random((parts, 7))
    n = rng.integers(1, 9, parts).astype(float)
    blobs = spark.createDataFrame([(i, float(n[i]), bytearray((w[i] * n[i]).tobytes())) for i in range(parts)], "part int, n double, w binary")
    assert np.allclose(lm._averaged(blobs, parts), (w * n[:, None]).sum(axis=0) / n.sum())


def test_every_rare_word_is_predicted(spark):
    """Rare words add log(n(word) / n(bucket)) each; the query asks for them."""
    from worktrail.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Only ASCII letters are lowered and only ASCII blanks part words.
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    known, ids, counts = lm.vocabulary(docs, "text")
    table = {r.key: np.frombuffer(bytes(r.tokens), dtype=np.int16).tolist() for r in lm.tokens(docs, known, ids, "doc_id", "text").collect()}
    total = Counter(w for ws in words.values() for w in ws)
    kept = lm.WORDS - lm.BUCKETS
    plain = {r.doc_id: r for r in score(docs).collect()}
    out = QUERIES["op9_lm_scoring"](spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "log_prob", "mean_log_prob"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(plain) and any(t >= kept for ts in table.values() for t in ts)
    for d, ws in words.items():
        more = sum(np.log(total[w] / counts[t]) for w, t in zip(ws, table[d], strict=True) if t >= kept)
        assert abs(got[d].log_prob - plain[d].log_prob - more) < 1e-3 * max(1, len(ws))
        assert abs(got[d].mean_log_prob - got[d].log_prob / max(1, len(ws))) < 1e-9 and got[d].n_tokens == len(ws)
    same = [(1, "a b"), (1, "a b"), (None, "a c"), (None, None)]
    rows = score(spark.createDataFrame(same, "doc_id long, text string"), every_word=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (0, 2), (1, 2), (1, 2)] and all(r.log_prob <= 0 for r in rows)
