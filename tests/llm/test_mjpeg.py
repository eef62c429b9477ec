import hashlib
import io
import zlib

import numpy as np
import pytest

from galleyproof.llm import mjpeg as M

TEXTS = ["", None, "short", "x" * 64, "y" * 65, "Über " * 3000, "".join(map(chr, range(1, 128))) * 90, "a" * 9000 + "ÿ\U0001f600" * 4000, "dup", "dup"]


def test_all_differences_round_trip():
    s = np.array([v for a in range(0, 256, 5) for b in range(256) for v in (a, b)], np.uint8)
    s = s[: len(s) // 64 * 64]
    assert (M.unpack_scan(M.pack_scan(s), len(s)) == s).all()
    with pytest.raises(ValueError):
        M.unpack_scan(M.pack_scan(s)[:100], len(s))


def test_another_decoder_agrees():
    image = pytest.importorskip("PIL.Image")
    s = np.random.default_rng(0).integers(0, 256, 64 * 8).astype(np.uint8)
    frame = M.jpeg_head(8) + M.pack_scan(s) + b"\xff\xd9"
    assert (np.asarray(image.open(io.BytesIO(frame)))[4::8, 4::8].reshape(-1) == s).all()


def test_query_columns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "'f' as feature")
    got = M.media_features(M.encode_media(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = M.write_avi(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert by[8][1:] == by[9][1:] and by[0][1:] == by[1][1:]
    assert M.media_features(M.encode_media(docs.limit(0))).count() == 0


def test_shots_follow_the_content(spark):
    docs = spark.createDataFrame([(1, "a" * 4096 * 6 + "\x7f" * 4096 * 5 + "Z" * 10), (2, "")], "doc_id long, text string")
    clips = M.clip_rows(M.encode_media(docs)).orderBy("doc_id", "clip").collect()
    assert [(r.doc_id, r.first_byte, r.end_byte) for r in clips] == [(1, 0, 24576), (1, 24576, 45056), (1, 45056, 45120), (2, 0, 64)]
    assert clips[0].end_ms == clips[1].start_ms == 6 * 40


def test_damage_is_found():
    media = bytearray(M.write_avi(b"q" * 640))
    media[media.rindex(b"00dc") + 8] ^= 1
    with pytest.raises(ValueError):
        M.read_avi(bytes(media))


def test_without_the_comment_all_samples_count():
    payload = bytes(range(256)) * 5
    whole = M.write_avi(payload)
    at = whole.index(b"ICMT")
    other = whole[:at] + b"ISFT" + whole[at + 4 :]
    samples, per = M.read_avi(other)
    assert samples.tobytes()[: len(payload)] == payload and len(samples) % per == 0
    assert M.read_avi(whole)[0].tobytes() == payload


def test_damaged_scans_are_told():
    import numpy as np
    import pytest

    samples = np.arange(512, dtype=np.uint8)
    scan = bytearray(M.pack_scan(samples))
    assert (M.unpack_scan(bytes(scan), 512) == samples).all()
    scan[200:202] = b"\x01\x01"
    with pytest.raises(ValueError):
        M.unpack_scan(bytes(scan), 512)


def test_shots_of_a_long_clip_take_linear_time():
    import time

    import numpy as np

    samples = np.random.default_rng(1).integers(0, 255, 40_000 * 64, dtype=np.uint8)
    samples[64 * 20_000 :] //= 8
    began = time.perf_counter()
    found = M.shots(samples, 64)
    assert time.perf_counter() - began < 5 and found[-1][1] == 40_000
