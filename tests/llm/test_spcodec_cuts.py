"""Texts are cut only where no piece reaches across; ids equal the library's on text of any kind."""

import random

import pyarrow as pa
import sentencepiece
from galleyproof.llm import pieces as P
from galleyproof.llm import spcodec

MODEL = P.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_no_piece_crosses_a_cut():
    work = spcodec.codec(MODEL)
    spelled = [p for p in work.pieces if not p.startswith(" ")]
    coded, row, _ = P.stretches(work.vocab, pa.chunked_array([spelled], pa.string()))
    last = dict(zip(row.tolist(), coded.to_pylist(), strict=True))
    assert [last[k].removeprefix(" ") for k in range(len(spelled))] == spelled


def test_ids_on_random_text():
    pick = random.Random(5)
    narrow = "abethin ▁ 是ß\n  ...,-=#0019éЖ中文한​😀\xa0\t"
    texts = ["".join(pick.choice(narrow) for _ in range(pick.randrange(60))) for _ in range(1500)]
    texts += ["".join(chr(pick.randrange(1, 0x3000)) for _ in range(pick.randrange(40))) for _ in range(1500)]
    for _ in range(2):  # the second time from the store
        ids, counts = spcodec.codec(MODEL).encode(pa.chunked_array([texts], pa.string()))
        at = 0
        for text, n in zip(texts, counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == LIBRARY.encode(text), repr(text)
            at += n


def test_store_turns_over(monkeypatch):
    monkeypatch.setattr(spcodec, "CACHE_BYTES", 3000)
    monkeypatch.setattr(spcodec, "WORD_BYTES", 40)
    work = spcodec.Codec(P.vocabulary(MODEL))
    for k in range(12):
        texts = [f"word{k % 3} and {k} others there", "and others", None, ""]
        ids, counts = work.encode(pa.chunked_array([texts], pa.string()))
        assert ids.tolist() == [i for t in texts for i in LIBRARY.encode(t or "")]
        assert counts.tolist() == [len(LIBRARY.encode(t or "")) for t in texts]
    assert len(work.known) + len(work.older) < 60
