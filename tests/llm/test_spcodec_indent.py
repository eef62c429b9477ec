"""Ids of indented stretches equal the library's at every length."""

import base64
import random

import pyarrow as pa
import pytest
import sentencepiece
from galleyproof.llm import pieces as P
from galleyproof.llm import spcodec

MODEL = P.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(text):
    found, counts = spcodec.codec(MODEL).encode(pa.chunked_array([[text]], pa.string()))
    assert counts.tolist() == [len(found)]
    return found.tolist()


def unspaced(kind, n):
    pick = random.Random(n)
    if kind == "words":
        return ("wordword" * n)[:n]
    if kind == "base64":
        return base64.b64encode(pick.randbytes(n)).decode()[:n]
    if kind == "cjk":
        return "".join(chr(pick.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    return "\n\tx=1;y".join(["f"] * n)[:n]


@pytest.mark.parametrize("n", [10, 4000, 5_000, 50_000])
@pytest.mark.parametrize("kind", ["words", "base64", "cjk", "tabs"])
def test_indent_before_unspaced_text(kind, n):
    body = unspaced(kind, n)
    for text in ("   " + body, "a   " + body, "  " + body + " end"):
        assert ids(text) == LIBRARY.encode(text)


@pytest.mark.parametrize("run", [3, 4, 17, 4094, 4095, 4097, 5_000])
def test_run_of_spaces_before_a_word(run):
    for text in (" " * run + "word", "a" + " " * run + "the end", " " * run):
        assert ids(text) == LIBRARY.encode(text)


def test_heap_merges_as_plain_merging():
    codec, pick = spcodec.codec(MODEL), random.Random(1)
    for _ in range(300):
        text = " " * pick.randrange(3, 20) + "".join(pick.choice("abethin 是ß\n") for _ in range(pick.randrange(40)))
        assert codec.merge_long(text) == codec.merge(text)
