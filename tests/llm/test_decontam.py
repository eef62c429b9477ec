import hashlib
import re

import numpy as np
import pytest

from galleyproof.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fixture():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(0, 14)))) for i in range(25)] + [(99, None), (3, "w1 W2 w3")]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(vocab + ["Zé", "other"], rng.integers(0, 60)))
        docs.append((i, text + ". " + items[i % 25][1].upper() + " tail"))
    return docs + [(7, docs[7][1]), (100, None), (101, ""), (None, "w1 w2 w3"), (102, "..!")], items


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_against_brute_force(spark, block):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as n_hit", "'y' as id")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.report(D.find_spans(d, b, block_bytes=block)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items), key=key)


def test_cut_removes_windows_and_keeps_clean_rows(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "char_length(text) as n_chars", "'x' as id")
    out = D.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == d.columns and out.count() == len(docs)
    before = {(r[0], r[1]): r[5] for r in brute(docs, items)}
    texts = {r.doc_id: r.text for r in out.collect()}
    for doc, text in docs:
        if not before[(doc, len(words(text)))]:
            assert texts[doc] == text


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.report(D.find_spans(d, b)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.report(D.find_spans(one, b)).first().n_words == 2


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 400)
    index = D.FMIndex(text, 5)
    for size in (1, 2, 5):
        patterns = rng.integers(1, 5, (50, size))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_null_item_ids(spark):
    d = spark.createDataFrame([(1, "one two three four"), (None, "one two")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "one two"), (7, "three four"), (None, "two three")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in D.report(D.find_spans(d, b)).collect()}
    import hashlib

    assert got == {1: (4, 2, hashlib.sha256(b"7").hexdigest()), None: (2, 1, hashlib.sha256(b"").hexdigest())}
