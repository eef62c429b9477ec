"""Media columns: AVI files with motion-JPEG frames.

Lossless storage in baseline JPEG: a sample s is a flat 8 x 8 block, so its only coefficient is DC = 8 (s - 128), kept exactly by
a quantiser of ones. The DC Huffman table gives category k a code of 12 - k bits, which k value bits follow, so each block takes
12 bits, and its end-of-block code one: every block has 13 bits, and a scan is packed and unpacked without a bit loop. Any JPEG
decoder shows the samples as flat squares.

The reader walks the RIFF chunks, takes the frames by ``idx1``, decodes each, and cuts the clip into shots where the difference of
consecutive frames' histograms exceeds an adaptive threshold (mean + 3 deviations over the preceding frames, and a floor).

Defined results: a null or empty text is 64 zero bytes, one frame of one row; equal texts give equal files and features; repeated
rows each give their own row; extra columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from galleyproof.llm import common as C

#: Blocks in a frame's row, most rows in a frame, frames a second.
WIDTH, MAX_ROWS, FPS = 64, 64, 25
BITS = 13
#: A shot starts where the histogram difference exceeds FLOOR and mean + DEVIATIONS * deviation of the shot's differences so far.
FLOOR, DEVIATIONS = 0.25, 3.0


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">HH", 0xFF00 | code, len(body) + 2) + body


@lru_cache(maxsize=256)
def jpeg_head(rows: int) -> bytes:
    """All of a frame up to the scan data: one grey component, unit quantiser, DC codes of 12 - k bits, AC codes of the end only."""
    dc_counts = [0] * 16
    for category in range(12):
        dc_counts[12 - category - 1] += 1
    dc = bytes([0x00, *dc_counts, *range(11, -1, -1)])
    ac = bytes([0x10, 1, *[0] * 15, 0x00])
    return (
        b"\xff\xd8"
        + _marker(0xDB, b"\x00" + b"\x01" * 64)
        + _marker(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + b"\x01\x11\x00")
        + _marker(0xC4, dc)
        + _marker(0xC4, ac)
        + _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


# A DC difference d of category k: code of 12 - k bits (all ones but the last, which is zero), then d's k value bits; then a 0 for the end.
_D = np.arange(-2040, 2041)
_K = np.where(_D == 0, 0, np.floor(np.log2(np.maximum(np.abs(_D), 1))).astype(int) + 1)
_PREFIX = ((1 << (12 - _K)) - 2).astype(np.int64)
CODE = (((_PREFIX << _K) | np.where(_D < 0, _D + (1 << _K) - 1, _D)) << 1).astype(np.uint16)
NO_CODE = 32767
BACK = np.full(1 << BITS, NO_CODE, np.int16)
BACK[CODE] = _D


def pack_scan(samples: np.ndarray) -> bytes:
    """Entropy-coded data of one frame's samples."""
    level = samples.astype(np.int16) * 8
    diff = np.empty(len(level), np.int16)
    diff[0] = level[0] - 1024
    np.subtract(level[1:], level[:-1], out=diff[1:])
    codes = CODE[diff + 2040].reshape(-1, 8).astype(np.uint64)
    # eight blocks are 104 bits: 13 bytes
    high = (codes[:, 0] << 51) | (codes[:, 1] << 38) | (codes[:, 2] << 25) | (codes[:, 3] << 12) | (codes[:, 4] >> 1)
    low = ((codes[:, 4] & 1) << 39) | (codes[:, 5] << 26) | (codes[:, 6] << 13) | codes[:, 7]
    out = np.empty((len(codes), 13), np.uint8)
    out[:, :8] = high.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = low.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return out.tobytes().replace(b"\xff", b"\xff\x00")


def unpack_scan(scan: bytes, count: int) -> np.ndarray:
    raw = np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)
    if len(raw) * 8 < count * BITS:
        raise ValueError("scan ends early")
    raw = raw[: count * BITS // 8].reshape(-1, 13)
    wide = np.zeros((len(raw), 16), np.uint8)
    wide[:, :8] = raw[:, :8]
    wide[:, 11:] = raw[:, 8:]
    pair = wide.view(">u8").astype(np.uint64)
    high, low = pair[:, 0], pair[:, 1]
    mask = np.uint64(0x1FFF)
    codes = np.stack([high >> 51, high >> 38, high >> 25, high >> 12, ((high & np.uint64(0xFFF)) << 1) | (low >> 39), low >> 26, low >> 13, low], 1) & mask
    diff = BACK[codes.reshape(-1).astype(np.int64)]
    if (diff == NO_CODE).any():
        raise ValueError("a code that the tables do not have")
    level = np.cumsum(diff, dtype=np.int64) + 1024
    if len(level) and (level.min() < 0 or level.max() > 2040 or (level & 7).any()):
        raise ValueError("a level that is no sample")
    return (level >> 3).astype(np.uint8)


def decode_frame(frame: bytes) -> np.ndarray:
    """Samples of one intra frame. Its tables must be the ones this writer uses: this is no decoder of other writers' frames."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, size = 2, (0, 0)
    while True:
        code, length = struct.unpack_from(">HH", frame, at)
        if code == 0xFFC0:
            precision, height, width, parts = struct.unpack_from(">BHHB", frame, at + 4)
            if precision != 8 or parts != 1:
                raise ValueError("not 8-bit grey")
            size = (height // 8, width // 8)
        at += 2 + length
        if code == 0xFFDA:
            break
    if frame[:at] != jpeg_head(size[0]) or size[1] != WIDTH:
        raise ValueError("tables of another writer")
    return unpack_scan(frame[at:-2], size[0] * size[1])


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """``payload`` (a positive multiple of 64 bytes) as a clip of equally large frames; the last is filled up with zero samples."""
    rows = min(MAX_ROWS, len(payload) // WIDTH)
    per = rows * WIDTH
    samples = np.frombuffer(payload + b"\x00" * (-len(payload) % per), np.uint8)
    head = jpeg_head(rows)
    movi, index, at = [], [], 4
    for k in range(0, len(samples), per):
        frame = head + pack_scan(samples[k : k + per]) + b"\xff\xd9"
        movi.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    count, largest = len(movi), max(map(len, movi))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, count, 0, 1, largest, WIDTH * 8, rows * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, count, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH * 8, rows * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH * 8, rows * 8, 1, 24, b"MJPG", WIDTH * rows * 192, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"samples=%d\x00" % len(payload)))
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def chunks(data: bytes, at: int, stop: int):
    """(name, list kind or None, body start, body end) of the chunks in a stretch."""
    while at + 8 <= stop:
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > stop:
            raise ValueError("chunk runs past its parent")
        if name in (b"RIFF", b"LIST"):
            yield name, data[at + 8 : at + 12], at + 12, at + 8 + size
        else:
            yield name, None, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[np.ndarray, int]:
    """All samples, and samples in a frame. Frames are found by the index and checked against the chunk they name.

    A comment chunk may say how many samples count; without one all do.
    """
    name, kind, at, stop = next(chunks(data, 0, len(data)))
    if (name, kind) != (b"RIFF", b"AVI "):
        raise ValueError("not an AVI file")
    movi, index, count = 0, b"", None
    for name, kind, a, b in chunks(data, at, stop):
        if kind == b"movi":
            movi = a - 4
        elif name == b"idx1":
            index = data[a:b]
        elif kind == b"INFO":
            for tag, _, c, d in chunks(data, a, b):
                if tag == b"ICMT" and data[c:d].startswith(b"samples="):
                    count = int(data[c:d].rstrip(b"\x00").removeprefix(b"samples="))
    frames = []
    for tag, _, offset, size in struct.iter_unpack("<4sIII", index):
        if struct.unpack_from("<4sI", data, movi + offset) != (tag, size):
            raise ValueError("index names no chunk")
        frames.append(decode_frame(data[movi + offset + 8 : movi + offset + 8 + size]))
    return np.concatenate(frames)[:count], len(frames[0])


def histograms(samples: np.ndarray, per: int) -> np.ndarray:
    """Each frame's histogram in 32 bins, as shares."""
    frame = np.arange(len(samples)) // per
    n = int(frame[-1]) + 1
    counts = np.bincount(frame * 32 + (samples >> 3), minlength=n * 32).reshape(n, 32)
    return counts / counts.sum(1, keepdims=True)


def shots(samples: np.ndarray, per: int) -> list[tuple[int, int]]:
    """Frame ranges of the shots."""
    share = histograms(samples, per)
    change = np.abs(np.diff(share, axis=0)).sum(1) / 2
    starts, seen, total, squares = [0], 0, 0.0, 0.0
    for k, x in enumerate(change.tolist(), 1):
        mean = total / seen if seen else 0.0
        deviation = max(0.0, squares / seen - mean * mean) ** 0.5 if seen else 0.0
        if x > FLOOR and x > mean + DEVIATIONS * deviation:
            starts.append(k)
            seen, total, squares = 0, 0.0, 0.0
        else:
            seen, total, squares = seen + 1, total + x, squares + x * x
    return list(zip(starts, [*starts[1:], len(share)], strict=True))


def feature(samples: np.ndarray, per: int) -> str:
    """Frames, timed shots, mean, deviation and the modal bin, all from decoded samples."""
    found = shots(samples, per)
    mean = int(samples.sum(dtype=np.int64)) * 1000 // len(samples)
    modal = int(np.bincount(samples >> 3, minlength=32).argmax())
    cuts = ",".join(f"{a * 1000 // FPS}-{b * 1000 // FPS}" for a, b in found)
    return f"frames={-(-len(samples) // per)};shots={len(found)};ms={cuts};mean={mean};bin={modal}"


def padded(text: bytes) -> bytes:
    return text + b"\x00" * (-len(text) % 64 or (0 if text else 64))


MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text) and media: the text's bytes as an AVI file in a binary column."""
    rows = C.own_columns(docs, id_col, text_col).toDF("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *MEDIA.fields[1:]])

    def encode(batches):
        for table in C.chunked(batches, "text", C.CHUNK_BYTES):
            data, at = C.flat_text(table["text"])
            raw = data.tobytes()
            media = [write_avi(padded(raw[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            out = pa.table([table["doc_id"], pa.array(np.diff(at)), pa.array(media, pa.binary())], names=schema.names)
            yield from out.to_batches(max_chunksize=1024)

    return C.narrow_batches(rows).mapInArrow(encode, schema)


DIGEST = T.StructType(
    [
        *MEDIA.fields[:2],
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def media_features(media: DataFrame) -> DataFrame:
    """One row per media value, from its decoded samples."""
    schema = T.StructType([media.schema["doc_id"], *DIGEST.fields[1:]])

    def describe(batches):
        for batch in batches:
            rows = []
            for file in batch.column("media").to_pylist():
                samples, per = read_avi(file)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(samples, per)))
            if rows:
                columns = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x) for x in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return media.mapInArrow(describe, schema)


def clip_rows(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_ms, end_ms, first_byte, end_byte: one row per shot."""
    schema = T.StructType([media.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("clip", "start_ms", "end_ms", "first_byte", "end_byte"))])

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, file in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples, per = read_avi(file)
                rows += [(doc, k, a * 1000 // FPS, b * 1000 // FPS, a * per, min(b * per, len(samples))) for k, (a, b) in enumerate(shots(samples, per))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=schema.names)

    return media.mapInArrow(cut, schema)


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_features(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
