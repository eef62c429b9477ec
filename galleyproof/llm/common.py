"""Shared pieces: the cluster's checkpoint folder, chunked Arrow maps, tokens as Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.operators.graph import unsized

#: Text bytes that one chunk of an Arrow map gathers before it is worked on. Bounds a worker's memory; results do not depend on it.
CHUNK_BYTES = 8 << 20
#: Rows of one emitted Arrow batch, and of one that a worker is sent.
OUT_ROWS, BATCH_ROWS = 1024, 1000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a local one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "galleyproof-checkpoints"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return unsized(df.checkpoint(eager=True))


_held: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps between its tasks: the tables of one operator at a time, so that a pipeline's stages do not add up."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what another operator left in this worker."""
    if _held:
        _held.clear()
        trim()


def trim() -> None:
    """Give memory that is free within the worker back to the system."""
    gc.collect()
    release()


def release() -> None:
    """Give buffers that are free back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunked(batches: Iterator[pa.RecordBatch], column: str, target: int) -> Iterator[pa.Table]:
    """Tables of consecutive batches with about ``target`` bytes in ``column``; rows are never split or reordered."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start = 0
        for stop in _cuts(lengths, target - size, target):
            held.append(batch.slice(start, stop - start))
            size += int(lengths[start:stop].sum())
            start = stop
            if size >= target:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if start < batch.num_rows:
            held.append(batch.slice(start))
            size += int(lengths[start:].sum())
    if held:
        yield pa.Table.from_batches(held)


def _cuts(lengths: np.ndarray, first: int, target: int) -> Iterator[int]:
    total = np.cumsum(lengths)
    at, limit = 0, first
    while at < len(lengths):
        stop = int(np.searchsorted(total, limit)) + 1
        if stop > len(lengths):
            return
        stop = max(stop, at + 1)
        yield stop
        at, limit = stop, int(total[stop - 1]) + target


def map_chunks(
    df: DataFrame,
    make: Callable[[], Callable[[pa.Table], pa.Table]],
    schema: T.StructType,
    text_col: str = "text",
    target: int = CHUNK_BYTES,
) -> DataFrame:
    """``mapInArrow`` over chunks of about ``target`` text bytes. ``make`` runs once per task and returns the chunk function.

    Only a ``make`` that is marked (``keeping``) leaves tables in the worker for its next task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not getattr(make, "keeping", False):
            let_go()
        work = make()
        for table in chunked(batches, text_col, target):
            yield from work(table).to_batches(max_chunksize=OUT_ROWS)
        del work
        trim()

    return narrow_batches(df).mapInArrow(run, schema)


def grouped(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``work`` on large groups, with the buffers of each given back after it: workers that wait hold little."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            release()

    return run


def keeping(make: Callable) -> Callable:
    """Mark a ``make`` that asks for its tables by ``kept``."""
    make.keeping = True
    return make


def narrow_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session held to BATCH_ROWS rows: texts are long, and a batch lies whole in the JVM and in the worker."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def flat_text(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another (null: empty), and the row offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def rebuilt(data: bytes, offsets: np.ndarray) -> pa.Array:
    """A string array over ``data``."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)])


def split_words(data: bytes, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space in document order, and each word's row. ``data`` is already folded."""
    lists = pc.ascii_split_whitespace(rebuilt(data, offsets))
    words = lists.flatten()
    sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    row = np.repeat(np.arange(len(offsets) - 1), sizes)
    kept = np.asarray(pc.binary_length(words)) > 0
    if not kept.all():
        words, row = words.filter(pa.array(kept)), row[kept]
    return words, row


#: A-Z to a-z, all other bytes unchanged.
FOLD_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: FOLD_TABLE, and ASCII other than letters and digits to space.
WORD_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + sizes[i]`` for all i, concatenated."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(np.asarray(starts, np.int64) - (ends - sizes), sizes) + np.arange(int(ends[-1]), dtype=np.int64)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def new_length(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Set ``n_chars`` anew where the table has it."""
    return df.withColumn("n_chars", F.char_length(F.col(text_col)).cast("long")) if "n_chars" in df.columns else df
