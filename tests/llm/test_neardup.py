import re

import numpy as np
import pytest

from galleyproof.llm import graph, neardup


def shingles(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            r = find(i)
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], least.get(find(i)), links[i]) for i in range(n)), key=str)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows, i = [], 0
    for base in range(30):
        words = rng.choice(vocab, rng.integers(40, 120)).tolist()
        for _ in range(int(rng.choice([1, 1, 2, 5]))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 4))):
                copy[rng.integers(len(copy))] = "changed" + str(rng.integers(1000))
            rows.append((i, " ".join(copy)))
            i += 1
    big = rng.choice(vocab, 300).tolist()
    for _ in range(60):
        copy = list(big)
        copy[rng.integers(len(copy))] = "edit" + str(rng.integers(10**6))
        rows.append((i, " ".join(copy)))
        i += 1
    return rows + [(900, rows[0][1].upper()), (901, rows[0][1]), (901, rows[0][1]), (902, None), (903, ""), (904, "!!"), (905, "one two"), (906, "One, two."), (None, rows[3][1]), (None, "no id at all here now"), (2, "other text for a repeated id two")]


@pytest.mark.parametrize("block", [16, 64])
def test_against_all_pairs(spark, block):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'k' as keys", "2 as id").repartition(3)
    got = sorted((tuple(r) for r in neardup.join_classes(docs, block=block).collect()), key=str)
    assert got == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'k' as kept")
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    silent = sum(not shingles(t) for _, t in rows)
    kept = out.collect()
    spoken = [r.doc_id for r in kept if shingles(r.text)]
    want = {(c if c is not None else "null") for i, c, _ in brute([r for r in rows if shingles(r[1])])}
    assert len(kept) - len(spoken) == silent and set(x if x is not None else "null" for x in spoken) == want
    assert neardup.keep_one(docs.limit(0)).count() == 0 and neardup.join_classes(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 460)]
    got = {}
    for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.comp, set()).add(r.node)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    want = {}
    for x in list(root):
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_shortening_reaches_the_target():
    depth = neardup.matched_depth()
    assert neardup.reached(depth) >= neardup.RECALL and (depth == neardup.MAX_DEPTH or neardup.reached(depth + 1) < neardup.RECALL)


def test_runs_of_the_sorted_paths(spark):
    """Ties within and across tasks join just the nodes that share a prefix in some tree."""
    pick = np.random.default_rng(4)
    size = neardup.MAX_DEPTH * neardup.PART
    # few first steps, so that runs are long and go over borders
    paths = {n: [bytes(pick.integers(0, 2, 2).repeat(2).tolist()) + bytes(pick.integers(0, 255, size - 4).tolist()) for _ in range(neardup.TREES)] for n in range(1, 40)}
    own = {n: [bytes([n + t, n]) * (size // 2) for t in range(neardup.TREES)] for n in range(100, 130)}
    rows = [(n, bytearray(b"".join(p))) for n, p in (paths | own).items()]
    frame = spark.createDataFrame(rows, "node long, paths binary").repartition(7)
    got = {r.node: r.comp for r in graph.components(neardup.ties(frame, 2)).collect()}
    assert set(got) == set(paths) and len(set(got.values())) == 1
    assert neardup.ties(frame.limit(0), 2).count() == 0


def test_a_long_chain_leaves_the_plan_small(spark):
    # the size that a join is thought to give was multiplied in every step; its digits filled the driver
    rng = np.random.default_rng(7)
    chain = [int(x) for x in rng.permutation(3000)]
    comps = graph.components(spark.createDataFrame(list(zip(chain[:-1], chain[1:], strict=True)), "a long, b long"))
    assert comps._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    rows = comps.collect()
    assert {r["node"] for r in rows} == set(chain)
    assert len({r["comp"] for r in rows}) == 1
