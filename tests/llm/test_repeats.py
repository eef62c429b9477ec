import hashlib

import numpy as np
import pytest

from galleyproof.llm import induced, repeats


def brute(rows, length):
    inf = float("inf")
    first = {}
    for i, t in rows:
        raw, i = (t or "").encode(), inf if i is None else i
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            first[w] = min(first.get(w, inf), i)
    out = []
    for i, t in rows:
        raw, own = (t or "").encode(), inf if i is None else i
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < own:
                gone[k + 1 : k + 1 + length] = True
        kept = bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    passages = ["".join(rng.choice(list("abcdé "), rng.integers(30, 400))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [passages[k][rng.integers(0, 40) :] if rng.random() < 0.5 else "".join(rng.choice(list("abcdefgh ü"), rng.integers(0, 200))) for k in rng.integers(0, 12, rng.integers(0, 6))]
        rows.append((int(i * 7 % n), "".join(parts)))
    rows += [(3, "z" * 500), (9, "z" * 700), (9, "z" * 60), (None, "z" * 90 + "tail"), (200, None), (201, ""), (202, "short"), (203, rows[5][1]), (204, rows[5][1]), (rows[5][0], rows[5][1])]
    return rows


@pytest.mark.parametrize(("length", "batch"), [(50, 3000), (50, 1 << 22), (30, 500)])
def test_against_brute_force(spark, length, batch):
    rows = corpus(length + batch)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'s' as scope", "2 as n_bytes").repartition(3)
    got = [tuple(r) for r in repeats.report(docs, min_len=length, gram=24 if length == 50 else 16, batch_bytes=batch).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, length), key=key)
    assert sum(r[2] for r in got) > 1000


def test_text_form_keeps_columns_and_clean_rows(spark):
    rows = [(1, "a" + "x1y2" * 40), (2, "Bé " + "x1y2" * 40 + " end"), (3, "clean text"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "char_length(text) as n_chars", "'k' as row", "5 as id")
    out = repeats.remove_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "Bé  end", 3: "clean text", 4: None}
    assert repeats.report(docs.limit(0)).count() == 0


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = rng.integers(0, rng.integers(2, 7), rng.integers(1, 60)).astype(np.uint8)
        raw, order = text.tobytes(), induced.suffix_array(text)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        common = induced.permuted_lcp(np.append(text + 1, 0).astype(np.uint8), order, 20)
        for k in range(1, len(order)):
            a, b, c = raw[order[k - 1] :] + b"a", raw[order[k] :] + b"b", 0
            while c < 20 and a[c] == b[c]:
                c += 1
            assert common[k] == c


def test_suffix_arrays_of_names_and_runs():
    pick = np.random.default_rng(3)
    for k in range(300):
        plain = pick.integers(0, pick.integers(1, 6), pick.integers(1, 60))
        for text in (plain, np.repeat(plain, pick.integers(1, 9, len(plain))), np.tile(plain, 4), plain * 100_000):
            want = sorted(range(len(text)), key=lambda i, t=text.tolist(): t[i:])
            assert induced.suffix_array(text.astype(np.int64)).tolist() == want
            if text.max() < 256:
                assert induced.suffix_array(text.astype(np.uint8)).tolist() == want
        if k % 50 == 0:  # longer than the rounds of packed symbols
            deep = np.concatenate([np.append(plain, [0] * 90 + [k % 7]) for k in range(6)])
            assert induced.suffix_array(deep.astype(np.uint8)).tolist() == sorted(range(len(deep)), key=lambda i, t=deep.tolist(): t[i:])


def test_a_megabyte_of_equal_bytes():
    n = 1 << 20
    assert (induced.suffix_array(np.full(n, 32, np.uint8)) == np.arange(n - 1, -1, -1)).all()


def test_a_text_is_carried_once(spark, monkeypatch):
    # batches held the text twice: in its row and beside it
    seen, cover = [], repeats.cover
    monkeypatch.setattr(repeats, "cover", lambda docs, *rest, **options: seen.append(docs) or cover(docs, *rest, **options))
    docs = spark.createDataFrame([(1, "en", "x" * 60), (2, "de", "x" * 60)], "doc_id long, lang string, text string")
    assert {tuple(r) for r in repeats.remove_repeats(docs).collect()} == {(1, "en", "x" * 60), (2, "de", "")}
    assert seen[0].schema["row"].dataType.names == ["doc_id", "lang"]
