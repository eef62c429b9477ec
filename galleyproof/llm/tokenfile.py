"""Token-ID output: independent zstandard frames, per-frame checksums, a trailing seek table.

File layout (the public zstd seekable format, with a document index in a skippable frame before the table)::

    frame 0 .. frame n-1     each an independent zstd frame of about FRAME_IDS ids, little-endian, 2 or 4 bytes an id
    skippable 0x184D2A50     zstd-compressed Arrow stream: doc_id, n_tokens of every document in order
    skippable 0x184D2A5E     seek table: (compressed size, decompressed size, xxh64 low 32 bits) per frame,
                             number of frames u32, descriptor u8 (0x80: checksums), magic 0x8F92EAB1

Any zstd tool decompresses a file as a whole; a reader of some documents reads the last bytes, the index, and only the frames
that hold those documents.

Documents are range-partitioned and sorted by id, each partition writes one file into the shared folder and a manifest row names
it, so a task that is run again after a lost executor writes a file of another name and the manifest names the one that counts.

Defined results: null and empty texts get the end id alone; a null id sorts first; rows with equal ids are ordered by text;
extra columns are passed over; an empty table writes no file.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.llm import common as C

FRAME_IDS = 1 << 16
LEVEL = 1
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Words whose ids a worker keeps; beyond it the cache starts anew. Bounds memory, never results.
CACHE_WORDS = 900_000

def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes distinct words between white space once.

    Right for tokenizers that drop white space and never join text across it. A word of letters and trailing marks is encoded as
    letters and marks, which such a tokenizer parts as well; so ``end``, ``end.`` and ``end,`` share their work.
    """

    MARKS = ".,;:!?"
    #: Letters that normalisation only lowers: these words go to the library's model past its normaliser and splitter.
    LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
    #: Byte-level spelling of bytes that are not printable; the others spell themselves.
    BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        plain = self.LETTERS.fullmatch
        rest = []
        tokenize, code, spelling, known = self.tokenizer.model.tokenize, self.dtype.char, self.BYTES, self.known
        for word in words:
            if plain(word):
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(spelling)
                known[word] = array(code, [t.id for t in tokenize(spelled)]).tobytes()
            else:
                rest.append(word)
        words = rest
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[word] = np.array(found.ids, self.dtype).tobytes()

    def encode(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and each text's number of ids."""
        data, offsets = C.flat_text(texts)
        words, row = C.split_words(data.tobytes(), offsets)
        if not len(words):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        parts: list[tuple[str, str]] = []
        plain = self.LETTERS.fullmatch
        for word in distinct:
            stem = word.rstrip(self.MARKS)
            parts.append((stem.lower(), word[len(stem) :]) if plain(stem.lower()) else (word, ""))
        known = self.known
        fresh = {x for p in parts for x in p if x and x not in known}
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            fresh = {x for p in parts for x in p if x}
        self._learn(list(fresh))
        known[""] = b""
        blobs = [known[a] + known[b] for a, b in parts]
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // width
        ids = np.frombuffer(b"".join(blobs), self.dtype)
        starts = np.cumsum(sizes) - sizes
        at = np.asarray(coded.indices)
        counts = np.bincount(row, weights=sizes[at], minlength=len(texts)).astype(np.int64)
        return ids[C.ragged(starts[at], sizes[at])], counts


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and tokenizer."""
    return C.kept(("tokenfile", path), lambda: WordEncoder(path))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class ShardWriter:
    """Writes one file, frame after frame; holds one frame and 16 bytes per document."""

    def __init__(self, uri: str, dtype: np.dtype, frame_ids: int = FRAME_IDS):
        fs, path = file_system(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.dtype, self.frame_ids = fs.open_output_stream(path, compression=None), dtype, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.held: list[np.ndarray] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(doc_ids)
        self.counts.append(counts)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_ids:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.frame_ids * self.frame_ids
            for at in range(0, whole, self.frame_ids):
                self._frame(flat[at : at + self.frame_ids].tobytes())
            self.held, self.size = [flat[whole:]], len(flat) - whole

    def _frame(self, raw: bytes) -> None:
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int]:
        if self.size:
            self._frame(np.concatenate(self.held).tobytes())
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], pa.int64())
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        sink = io.BytesIO()
        table = pa.table({"doc_id": ids, "n_tokens": pa.array(counts, pa.int64())}).replace_schema_metadata({"width": str(self.dtype.itemsize)})
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        index = self.compressor.compress(sink.getvalue())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.frames.append((len(index) + 8, 0, 0))
        table_bytes = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table_bytes)) + table_bytes)
        self.out.close()
        return len(counts), int(counts.sum())


class ShardReader:
    """Reads the seek table and the document index, then only the frames asked for; checks every frame it reads."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError(f"no seek table in {uri}")
        rows = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.cumsum(rows[:, 0]) - rows[:, 0]
        self.packed, self.raw, self.sums = rows[:, 0], rows[:-1, 1], rows[:-1, 2]
        index = self.file.read_at(int(rows[-1, 0]) - 8, int(self.at[-1]) + 8)
        self.decompressor = zstandard.ZstdDecompressor()
        table = pa.ipc.open_stream(self.decompressor.decompress(index)).read_all()
        self.dtype = np.dtype(f"<u{int(table.schema.metadata[b'width'])}")
        self.doc_ids = table["doc_id"].combine_chunks()
        self.counts = np.asarray(table["n_tokens"], dtype=np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.frame_end = np.cumsum(self.raw) // self.dtype.itemsize

    def frame(self, k: int) -> np.ndarray:
        raw = self.decompressor.decompress(self.file.read_at(int(self.packed[k]), int(self.at[k])), max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, self.dtype)

    def documents(self, which: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the file, ids) of the documents at the given places, in order; all by default."""
        held, of = np.zeros(0, self.dtype), -1
        for i in range(len(self.counts)) if which is None else which:
            parts, at, stop = [], int(self.starts[i]), int(self.starts[i] + self.counts[i])
            while at < stop:
                k = int(np.searchsorted(self.frame_end, at, side="right"))
                if k != of:
                    held, of = self.frame(k), k
                base = int(self.frame_end[k]) - len(held)
                parts.append(held[at - base : stop - base])
                at += len(parts[-1])
            yield i, np.concatenate(parts) if parts else held[:0]


MANIFEST = T.StructType([T.StructField("shard", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write files in ascending id order below ``folder``; the manifest (one row per file) comes back computed."""
    rows = C.own_columns(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        task = TaskContext.get()
        uri = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.tokens.zst"
        work, writer = encoder(tokenizer), None
        for table in C.chunked(batches, "text", C.CHUNK_BYTES):
            ids, counts = work.encode(table["text"])
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            writer = writer or ShardWriter(uri, work.dtype, frame_ids)
            writer.add(table["doc_id"].combine_chunks(), ids, counts + 1)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": uri, "n_docs": n_docs, "n_tokens": n_tokens}])

    return C.settle(C.narrow_batches(rows).mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame, id_type: T.DataType = T.LongType()) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every document, read back from the files.

    The driver holds one row per file.
    """
    spark = manifest.sparkSession
    files = sorted((r.shard, r.path, r.n_tokens) for r in manifest.collect())
    base, plan = 0, []
    for shard, path, n in files:
        plan.append((shard, path, base))
        base += n
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32", "shard"))])

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, path, start = plan[k]
                reader = ShardReader(path)
                sums = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.documents()), np.int64, len(reader.counts))
                table = pa.table([reader.doc_ids, pa.array(reader.starts + start), pa.array(reader.counts), pa.array(sums), pa.array(np.full(len(sums), shard))], names=schema.names)
                yield from table.to_batches(max_chunksize=1 << 16)

    if not plan:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(plan), 1, len(plan)).mapInArrow(read, schema)


def read_documents(manifest: DataFrame, doc_ids: list) -> dict:
    """The ids of some documents, reading only the frames that hold them."""
    want, found = pa.array(doc_ids), {}
    for r in manifest.toLocalIterator():
        reader = ShardReader(r.path)
        places = np.flatnonzero(np.asarray(pc.is_in(reader.doc_ids, value_set=want.cast(reader.doc_ids.type))))
        found |= {reader.doc_ids[i].as_py(): ids for i, ids in reader.documents(places.tolist())}
    return found


def op2_token_binary_output(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{C.checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, default_tokenizer()), docs.schema["doc_id"].dataType)
