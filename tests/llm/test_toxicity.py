import zlib

import numpy as np
import pyarrow as pa
import pytest

from galleyproof.llm import toxicity as X


def test_gradient_matches_differences():
    rng = np.random.default_rng(3)
    net = X.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = X.Words(pa.array(["one two three four five six", "seven eight " * 20]))
    windows, _ = words.windows()
    x = net.inputs(words).astype(np.float64)
    weight = rng.normal(size=len(windows))
    tape = {}
    net.logits(x, windows, tape)
    g, dx = net.gradient(x, tape, weight)
    loss = lambda: float(net.logits(x, windows) @ weight)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        k, old = int(rng.integers(len(flat))), None
        old = flat[k]
        flat[k] = old + 1e-3
        up = loss()
        flat[k] = old - 1e-3
        down = loss()
        flat[k] = old
        assert abs((up - down) / 2e-3 - g[name].reshape(-1)[k]) < 5e-3, name
    x[1, 2] += 1e-3
    up = loss()
    x[1, 2] -= 2e-3
    assert abs((up - loss()) / 2e-3 - dx[1, 2]) < 5e-3


def test_windows_cover_every_word_and_overlap():
    words = X.Words(pa.array(["w " * n for n in (0, 1, 32, 33, 100)]))
    windows, row = words.windows()
    assert np.bincount(row).tolist() == [1, 1, 1, 2, 6]
    text = " ".join(f"w{i}" for i in range(100))
    windows, _ = X.Words(pa.array([text])).windows()
    seen = [set(w.tolist()) for w in windows]
    assert set().union(*seen) == set(range(100)) and all(a & b for a, b in zip(seen, seen[1:], strict=False))


def test_held_out_accuracy_and_columns(spark):
    path = "/root/testdata/sf0.1"
    out = X.op7_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1), (None, 1, 1), (3, None, None)]])
def test_edges(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string").selectExpr("*", "'x' as score", "1 as toxic")
    net = X.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = X.score(docs, net).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id in (1, 4, None)}) == 1
    assert X.keep_clean(docs, net, 1.1).columns == docs.columns
    assert X.keep_clean(docs.limit(0), net).count() == 0
