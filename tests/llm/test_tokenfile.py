import struct
import zlib

import numpy as np
import pytest
import zstandard

from galleyproof.llm import tokenfile as K

TEXTS = [
    "Hello, world! It's 42 degrees.", None, "", " \n\t ", "don't we'll I'D they're", "naïve Ünïcode… “quoted” x.y,z", "a" * 5000,
    "<|endoftext|> in <|startoftext|>text", "éclair é.", "\x1f\x0b\x0cfoo bar baz", "日本語のテキスト。", "same text", "same text", "ends... with?! marks.,;", "İstanbul ΣΑΣ.", "🙂👍🏽 ok", "foo\x00bar", "'s 's'T a's.", "x.'s,",
]


def direct(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(K.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 1]


def test_files_hold_what_the_library_gives(spark, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS * 4)] + [(None, "no id"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as shard").repartition(3)
    manifest = K.write_token_files(docs, f"file://{tmp_path}/out", K.default_tokenizer(), frame_ids=64)
    got = K.read_token_files(manifest).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    start = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = direct(text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = K.read_documents(manifest, [6, 9])
    assert {k: v.tolist() for k, v in some.items()} == {6: [1], 9: [1]} or all(v.tolist() == direct(TEXTS[k // 3 % len(TEXTS)]) for k, v in some.items())


def test_frames_are_independent_and_checked(tmp_path):
    uri = f"{tmp_path}/a.zst"
    import pyarrow as pa

    w = K.ShardWriter(uri, np.dtype("<u2"), 10)
    w.add(pa.array([5, 6, 7]), np.arange(35, dtype="<u2"), np.array([3, 30, 2]))
    assert w.close() == (3, 35)
    raw = open(uri, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert np.frombuffer(whole, "<u2").tolist() == list(range(35))
    r = K.ShardReader(uri)
    assert [v.tolist() for _, v in r.documents([2])] == [[33, 34]] and [v.tolist() for _, v in r.documents()][1] == list(range(3, 33))
    assert struct.unpack("<I", raw[-4:])[0] == K.SEEKABLE_MAGIC
    damaged = bytearray(raw)
    damaged[int(r.at[1]) + 9] ^= 1
    open(uri, "wb").write(damaged)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(K.ShardReader(uri).documents())


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert K.read_token_files(K.write_token_files(docs, f"{tmp_path}/out", K.default_tokenizer())).count() == 0
