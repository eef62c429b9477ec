import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from galleyproof.llm import ngramtrie as G

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows, order):
    count = [Counter() for _ in range(order)]
    for i, text in rows:
        if not held(i):
            t = tokens(text)
            for k in range(order):
                count[k].update(tuple(t[j : j + k + 1]) for j in range(len(t) - k))
    n, v = sum(count[0].values()), len(count[0])
    out = []
    for i, text in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for j, w in enumerate(t):
            p = (count[0][(w,)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, min(order, j + 1)):
                gram = tuple(t[j - k : j + 1])
                p = (count[k][gram] + G.PRIOR * p) / (count[k - 1][gram[:-1]] + G.PRIOR)
            score += math.log10(p)
        out.append((i, held(i), len(t), sum(count[0][(w,)] > 0 for w in t), n, base, score))
    return out


def corpus():
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(40)] + ["The", "THE", "é x", "a,b"]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 60), p=None))) for i in range(80)]
    return rows + [(1, "w1 w1 w1"), (200, None), (201, ""), (202, " \t\n"), (None, "the w1"), (203, rows[3][1]), (203, rows[3][1])]


@pytest.mark.parametrize(("order", "chunk"), [(2, 400), (3, 1 << 20)])
def test_against_brute_force(spark, order, chunk):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'h' as held_out", "1 as score", "2 as id").repartition(3)
    got = sorted((tuple(r) for r in G.score_documents(docs, G.held_out(), order=order, chunk=chunk).collect()), key=str)
    want = sorted(brute(rows, order), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], rel=2e-3, abs=2e-3)


def test_probabilities_sum_to_one():
    count = Counter({"a": 5, "b": 3, "c": 1})
    follow = Counter({"a": 2, "b": 2})
    n, v = sum(count.values()), 3
    lower = {w: (count[w] + 1) / (n + v + 1) for w in [*count, "?"]}
    assert sum((follow[w] + G.PRIOR * lower[w]) / (4 + G.PRIOR) for w in lower) == pytest.approx(1)


def test_elias_fano_and_trie(tmp_path):
    rng = np.random.default_rng(2)
    for n, u in ((1, 1), (5, 5), (100, 10_000_000), (1000, 1200), (300, 1 << 45)):
        values = np.unique(rng.integers(0, u, n))
        e = G.EliasFano.build(values, u)
        assert (e[np.arange(len(values))] == values).all()
        probe = np.concatenate((values, rng.integers(0, u, 200)))
        at = {v: i for i, v in enumerate(values.tolist())}
        assert e.find(probe).tolist() == [at.get(x, -1) for x in probe.tolist()]
    grams = np.unique(rng.integers(0, 50, (800, 3)), axis=0)
    counts = rng.integers(1, 100_000, len(grams))
    G.Trie.build(list(grams.T), counts).save(f"{tmp_path}/t/x.trie")
    trie = G.Trie.open(f"file://{tmp_path}/t/x.trie")
    have = {tuple(g): c for g, c in zip(grams.tolist(), counts.tolist(), strict=True)}
    probe = np.concatenate((grams, rng.integers(0, 60, (500, 3))))
    want = np.array([have.get(tuple(p), 0) for p in probe.tolist()])
    assert (trie.find(list(probe.T)) == G.quantise(want)).all()
    assert np.allclose(G.restore(G.quantise(want)), want, rtol=4e-4)


def test_empty_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    assert G.score_documents(docs.limit(0), G.held_out()).count() == 0
    from pyspark.sql import functions as F

    r = G.score_documents(docs, F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_better_than_single_words_on_held_out_text(spark):
    rows = [r for r in G.op3_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
