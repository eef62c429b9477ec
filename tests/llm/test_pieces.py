import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from galleyproof.llm import pieces as P
from galleyproof.llm import spcodec, tokencounts

ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b\n\n c d  ", "    deep   indent\n\t    x", "naïve Über straße 日本語 🙂👍🏽 \x00\x7f", "x" * 3000,
    "literal ▁ mark", "the theatre thereof then The THE", "1234567890 12 3.14", "a b　c", "\n" * 50, "tion" * 200, "same", "same", "<s> </s> <unk> <0x41>",
]


@pytest.fixture(scope="module")
def texts():
    found = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    return ODD + found


def test_ids_are_those_of_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    ids, counts = spcodec.codec(P.default_model()).encode(pa.chunked_array([texts]))
    stop = np.cumsum(counts)
    for text, a, b in zip(texts, stop - counts, stop, strict=True):
        assert ids[a:b].tolist() == library.encode(text or ""), repr(text)[:80]


def test_round_trip_query(spark, texts):
    rows = list(enumerate(texts)) + [(None, "x"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as ids", "0 as n_tokens")
    out = spcodec.decode(spcodec.encode(docs, P.default_model()), P.default_model()).collect()
    want = sorted((i is not None, i or 0, (t or "").replace("▁", " ")) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in out) == want
    library = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    by = {r.doc_id: r for r in out}
    assert by[6].ids_crc32 == zlib.crc32(np.array(library.encode(ODD[6]), "<u4").tobytes())
    assert spcodec.round_trip(docs.limit(0), P.default_model()).count() == 0


def best(word, vocab, unknown, longest=16):
    """Plain dynamic programme: (score, tokens) of each prefix."""
    state = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(state[end - 1][0] + unknown - size, state[end - 1][1] + size)]
        for start in range(max(0, end - longest), end):
            if word[start:end] in vocab:
                options.append((state[start][0] + vocab[word[start:end]], state[start][1] + 1))
        state.append(max(options, key=lambda o: o[0]))
    return state[-1][1]


def test_counts_against_plain_programme(spark, texts):
    trie = tokencounts.ScoreTrie(P.vocabulary(P.default_model()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as id")
    got = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(docs, P.default_model()).collect()}
    for i, text in list(enumerate(texts))[:60]:
        whole = (" " + text.replace(P.SPACE, " ")) if text else ""
        assert got[i] == best(whole, trie.vocab, trie.unknown), repr(text)[:60]
    assert tokencounts.count_tokens(docs.limit(0), P.default_model()).count() == 0


def test_a_small_trie_gives_the_same_counts(monkeypatch, texts):
    whole = tokencounts.ScoreTrie(P.vocabulary(P.default_model()))
    words = P.stretches(whole.vocabulary, pa.chunked_array([texts]))[0].dictionary.to_pylist()
    want = whole.token_counts(words)
    monkeypatch.setattr(tokencounts, "MAX_NODES", 10)
    small = tokencounts.ScoreTrie(P.vocabulary(P.default_model()))
    assert small.token_counts(words).tolist() == want.tolist()
    monkeypatch.setattr(tokencounts, "DEEP", 2)
    assert small.token_counts(words).tolist() == want.tolist()


def test_a_long_word_stays_within_the_nodes():
    trie = tokencounts.ScoreTrie(P.vocabulary(P.default_model()))
    short, longer, long = trie.token_counts(["tion" * n for n in (100, 200, 200_000)]).tolist()
    assert long == short + (longer - short) * 1999
    assert len(trie.best) < 1000


def test_pretokens(spark):
    texts = ["", None, "a", " a  b c ", "  ", "x\ny z.z", "▁a▁b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_pretokens for r in tokencounts.count_tokens(docs, P.default_model()).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 0, 1, 4, 1, 2, 2]
