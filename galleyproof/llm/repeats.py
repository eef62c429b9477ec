"""Repeated passages over all documents, by suffix arrays on content-routed shards.

Every window of ``min_len`` bytes has a key: the least hash of its 24-byte grams. Consecutive windows of one key form a stretch, and
equal windows have equal keys, so the shard a key falls to sees every occurrence of its windows. Steps, each a map over batches of
documents or over shards:

1. each batch sends the shards its distinct keys; a shard answers which keys more than one document has;
2. each batch sends the distinct stretches of those keys, with the least and greatest document id that holds each;
3. a shard concatenates its distinct stretches, sorts their suffixes by induced sorting, computes permuted common prefixes, and
   groups windows of a common prefix of ``min_len``; each window's answer is one bit;
4. each batch turns the bits into covered bytes.

A passage that very many documents share reaches a shard once per batch, and a source or key of any size is spread over the shards
by its passages. What moves is keys (4 bytes for about 14 bytes of text) and distinct repeated stretches, not texts against texts.
Batches lie in the shared checkpoint folder, so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.llm import common as C
from galleyproof.llm import induced as I

#: Length of a removed string in bytes, and of the grams whose least hash is a window's key.
MIN_LEN, GRAM = 50, 24
#: Shards for each shuffle partition.
SHARDS_PER_PARTITION = 4
NO_ID = np.iinfo(np.int64).max

ROW = T.StructType([T.StructField("batch", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("body", T.BinaryType())])
NAMES = ROW.names


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return zstandard.compress(sink.getvalue(), 1)


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(body)).read_all()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<cBQ", a.dtype.char.encode(), a.dtype.itemsize, len(a)) for a in arrays)
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def unpack_arrays(body: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(body)
    count, at = raw[0], 1
    heads = [struct.unpack_from("<cBQ", raw, at + 10 * k) for k in range(count)]
    at += 10 * count
    out = []
    for char, size, n in heads:
        out.append(np.frombuffer(raw, np.dtype(char.decode()), n, at))
        at += size * n
    return out


#: Positions that are hashed at a time.
KEY_BLOCK = 1 << 16


def window_keys(text: np.ndarray, min_len: int, gram: int) -> np.ndarray:
    """For each position the least gram hash of the window that starts there (windows that run past the text are meaningless)."""
    words = I.byte_words(text, min_len + gram)
    n, span = len(text), min_len - gram + 1
    out = np.empty(n, np.uint64)
    for a in range(0, n, KEY_BLOCK):
        b = min(n, a + KEY_BLOCK)
        stop = b + span - 1
        h = words[a:stop] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8, gram, 8):
            h ^= h >> np.uint64(29)
            k = min(k, gram - 8)
            h += words[a + k : stop + k]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        width = 1
        while width * 2 <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
        out[a:b] = h
    return out


def distinct(strings: pa.Array, scope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each string's place among the distinct (string, scope), in order of appearance, and where each of those first stands."""
    place = np.asarray(strings.dictionary_encode().indices, dtype=np.int64)
    if len(scope) and scope.min() != scope.max():
        which, place = np.unique(scope, return_inverse=True)[1], place.copy()
        _, first, back = np.unique(place * (int(which.max()) + 1) + which, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        place = rank[back]
    first = np.empty(int(place.max(initial=-1)) + 1, np.int64)
    first[place[::-1]] = np.arange(len(place))[::-1]
    return place, first


class Batch:
    """A batch's texts, its stretches, and their codes (shard and a 32-bit rest of the key)."""

    def __init__(self, table: pa.Table, shards: int, min_len: int, gram: int):
        self.table = table
        self.text, self.offsets = C.flat_text(table["text"])
        self.ids = np.asarray(pc.fill_null(table["id"], int(NO_ID)), dtype=np.int64)
        scope = np.asarray(table["scope"], dtype=np.int64)
        stop = np.maximum(self.offsets[1:] - min_len + 1, self.offsets[:-1])
        has = stop > self.offsets[:-1]
        key = window_keys(self.text, min_len, gram)
        # a stretch starts where the key changes, and with its text; no window starts in a text's last bytes
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[self.offsets[:-1][has]] = True
        edge = np.zeros(len(key) + 1, np.int8)
        edge[self.offsets[:-1][has]] += 1
        edge[stop[has]] -= 1
        new &= np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        self.start = np.flatnonzero(new)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.count = np.minimum(np.append(self.start[1:], len(key)), stop[self.doc]) - self.start
        self.scope = scope[self.doc]
        key = key[self.start] ^ (self.scope.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.shard = (key % np.uint64(shards)).astype(np.int64)
        self.code = (self.shard << 32) | ((key // np.uint64(shards)) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def sets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes in order, whether more than one document here has it, and each stretch's code's place."""
        codes, back = np.unique(self.code, return_inverse=True)
        ids = self.ids[self.doc]
        low = np.full(len(codes), NO_ID)
        high = np.full(len(codes), np.iinfo(np.int64).min)
        np.minimum.at(low, back, ids)
        np.maximum.at(high, back, ids)
        return codes, low != high, back

    def shared(self, answers: dict[int, bytes]) -> np.ndarray:
        """Stretches whose key more than one document has, ordered by shard."""
        codes, _, back = self.sets()
        flag = np.zeros(len(codes), bool)
        shard = codes >> 32
        for s, body in answers.items():
            a, b = np.searchsorted(shard, [s, s + 1])
            flag[a:b] = np.unpackbits(np.frombuffer(body, np.uint8), count=b - a).astype(bool)
        use = np.flatnonzero(flag[back])
        return use[np.argsort(self.shard[use], kind="stable")]

    def strings(self, use: np.ndarray, min_len: int):
        """Distinct stretches in the order sent: place of each used stretch among them, and their (shard, scope, bytes, least id, greatest id)."""
        raw = self.text.tobytes()
        start, stop = self.start[use].tolist(), (self.start[use] + self.count[use] + min_len - 1).tolist()
        strings = pa.array([raw[a:b] for a, b in zip(start, stop, strict=True)], pa.large_binary())
        place, first = distinct(strings, self.scope[use])
        ids = self.ids[self.doc[use]]
        low, high = np.full(len(first), NO_ID), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        return place, self.shard[use[first]], self.scope[use[first]], strings.take(pa.array(first)), low, high


def _pack_batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    def run(batches):
        C.let_go()
        task, k = TaskContext.get().partitionId(), 0
        for table in C.chunked(batches, "text", batch_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([(task << 24) + k]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([pack(table)])], names=NAMES)
            k += 1

    return C.settle(C.narrow_batches(docs).mapInArrow(run, ROW))


def _ranges(cuts: list[int], stop: int) -> list[tuple[int, int]]:
    return list(zip(cuts, [*cuts[1:], stop][: len(cuts)], strict=True))


def _rows(batch, kind, shards, bodies) -> pa.Table:
    n = len(shards)
    return pa.table([pa.array(np.full(n, batch), pa.int64()), pa.array(np.full(n, kind), pa.int32()), pa.array(np.asarray(shards), pa.int32()), pa.array(bodies, pa.binary())], names=NAMES)


def _send_sets(batches: DataFrame, shards: int, min_len: int, gram: int) -> DataFrame:
    def run(rows):
        for record in rows:
            for number, body in zip(record.column("batch").to_pylist(), record.column("body").to_pylist(), strict=True):
                codes, many, _ = Batch(unpack(body), shards, min_len, gram).sets()
                shard = codes >> 32
                cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
                bodies = [pack_arrays((codes[a:b] & 0xFFFFFFFF).astype(np.uint32), np.packbits(many[a:b])) for a, b in _ranges(cuts, len(codes))]
                yield from _rows(number, 1, shard[cuts], bodies).to_batches()

    return batches.mapInArrow(run, ROW)


def _answer_sets(table: pa.Table) -> pa.Table:
    bodies = [unpack_arrays(b) for b in table["body"].to_pylist()]
    codes = np.concatenate([b[0] for b in bodies])
    many = np.concatenate([np.unpackbits(b[1], count=len(b[0])) for b in bodies]).astype(bool)
    _, back, count = np.unique(codes, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[back[many]] = True
    bits = shared[back]
    stop = np.cumsum([len(b[0]) for b in bodies])
    out = [np.packbits(bits[e - len(b[0]) : e]).tobytes() for e, b in zip(stop.tolist(), bodies, strict=True)]
    return pa.table([table["batch"], table["kind"], table["shard"], pa.array(out, pa.binary())], names=NAMES)


def _by_kind(table: pa.Table) -> tuple[int, pa.Table, dict[int, dict[int, bytes]]]:
    answers: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
    batch = None
    for number, kind, shard, body in zip(*(table[c].to_pylist() for c in NAMES), strict=True):
        if kind == 0:
            batch = body
        else:
            answers[kind][shard] = body
    return number, unpack(batch), answers


def _answer_strings(table: pa.Table, min_len: int, smaller: bool) -> pa.Table:
    """Suffix array over a shard's distinct stretches; one bit a window."""
    bodies = [unpack_arrays(b) for b in table["body"].to_pylist()]
    all_sizes, all_scope, all_low, all_high, all_bytes = (np.concatenate(x) for x in zip(*bodies, strict=True))
    strings = C.rebuilt(all_bytes.tobytes(), np.concatenate(([0], np.cumsum(all_sizes, dtype=np.int64)))).cast(pa.large_binary())
    place, known = distinct(strings, all_scope)
    places = np.split(place, np.cumsum([len(b[0]) for b in bodies])[:-1])
    low, high = np.full(len(known), NO_ID), np.full(len(known), np.iinfo(np.int64).min)
    np.minimum.at(low, place, all_low)
    np.maximum.at(high, place, all_high)
    scope, sizes = all_scope[known], all_sizes[known].astype(np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    # the end of a string is the least symbol
    symbols = np.zeros(int(sizes.sum()) + len(sizes), np.uint8)
    symbols[C.ragged(begin, sizes)] = C.flat_text(strings.take(pa.array(known)))[0]
    symbols[C.ragged(begin, sizes)] += 1
    windows = sizes - min_len + 1
    order = I.suffix_array(symbols)
    stretch = np.repeat(np.arange(len(sizes)), sizes + 1)
    valid = np.arange(len(symbols)) - begin[stretch] < windows[stretch]
    order = order[valid[order]]
    new = I.permuted_lcp(symbols, order, min_len) < min_len
    group = np.cumsum(new) - 1
    holder = stretch[order]
    if len(np.unique(scope)) > 1:
        group = np.unique(np.stack((group, scope[holder]), 1), axis=0, return_inverse=True)[1].reshape(-1)
    n = int(group.max()) + 1
    first, last = np.full(n, NO_ID), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(first, group, low[holder])
    np.maximum.at(last, group, high[holder])
    at_text = np.zeros(len(symbols), np.int64)
    at_text[order] = first[group] if smaller else first[group] != last[group]
    out = []
    for (b_sizes, _, b_low, _, _), where in zip(bodies, places, strict=True):
        count = b_sizes.astype(np.int64) - min_len + 1
        value = at_text[C.ragged(begin[where], count)]
        bits = value < np.repeat(b_low, count) if smaller else value != 0
        out.append(np.packbits(bits).tobytes())
    return pa.table([table["batch"], pa.array(np.full(len(out), 2), pa.int32()), table["shard"], pa.array(out, pa.binary())], names=NAMES)


def _covered(batch: Batch, answers: dict[int, dict[int, bytes]], min_len: int, smaller: bool) -> np.ndarray:
    """Bytes of the batch's texts inside a window to be removed."""
    hit = np.zeros(len(batch.text) + 1, np.int64)
    if len(batch.start):
        use = batch.shared(answers[1])
        place, shard, _, strings, low, _ = batch.strings(use, min_len)
        count = np.asarray(pc.binary_length(strings), dtype=np.int64) - min_len + 1
        bits = []
        for s in np.unique(shard).tolist():
            bits.append(np.unpackbits(np.frombuffer(answers[2][s], np.uint8), count=int(count[shard == s].sum())))
        if bits:
            flat = np.concatenate(bits).astype(bool)
            begin = np.cumsum(count) - count
            removed = flat[C.ragged(begin[place], count[place])]
            if smaller:
                removed |= np.repeat(batch.ids[batch.doc[use]] > low[place], count[place])
            hit[C.ragged(batch.start[use], count[place])[removed]] = 1
    total = np.concatenate(([0], np.cumsum(hit[:-1])))
    at = np.arange(len(batch.text))
    return total[at + 1] > total[np.maximum(at - min_len + 1, 0)]


def batch_size(shards: int) -> int:
    """Bytes of a batch: more of them as shards grow in number, so that a message to a shard stays worth its overhead."""
    return int(min(48 << 20, max(4 << 20, shards * (8 << 10))))


def cover(
    docs: DataFrame,
    finish: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table],
    schema: T.StructType,
    min_len: int = MIN_LEN,
    gram: int = GRAM,
    smaller: bool = True,
    batch_bytes: int | None = None,
) -> DataFrame:
    """Find covered bytes. ``docs`` has id (long), scope (long), text, and any columns to carry.

    ``smaller``: a window counts where a document of a smaller id has it too; else where any other id of its scope has it.
    ``finish(table, text bytes, offsets, covered)`` makes the rows of a batch.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = SHARDS_PER_PARTITION * partitions
    batches = _pack_batches(docs, batch_bytes or batch_size(shards))

    def send_strings(table: pa.Table) -> pa.Table:
        number, texts, answers = _by_kind(table)
        batch = Batch(texts, shards, min_len, gram)
        if not len(batch.start):
            return _rows(number, 2, [], [])
        _, shard, scope, strings, low, high = batch.strings(batch.shared(answers[1]), min_len)
        raw, at = C.flat_text(strings)
        size = np.diff(at).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
        bodies = [pack_arrays(size[a:b], scope[a:b], low[a:b], high[a:b], raw[at[a] : at[b]]) for a, b in _ranges(cuts, len(strings))]
        return _rows(number, 2, shard[cuts], bodies)

    def finish_batch(table: pa.Table) -> pa.Table:
        _, texts, answers = _by_kind(table)
        batch = Batch(texts, shards, min_len, gram)
        return finish(texts, batch.text, batch.offsets, _covered(batch, answers, min_len, smaller))

    sets = _send_sets(batches, shards, min_len, gram)
    shared = C.settle(sets.groupBy("shard").applyInArrow(C.grouped(_answer_sets), ROW))
    known = batches.unionAll(shared)
    strings = known.groupBy("batch").applyInArrow(C.grouped(send_strings), ROW)
    bits = strings.groupBy("shard").applyInArrow(C.grouped(lambda t: _answer_strings(t, min_len, smaller)), ROW)
    return known.unionAll(bits).groupBy("batch").applyInArrow(C.grouped(finish_batch), schema)


def spans_of(covered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal covered runs, positions within the row's text."""
    edge = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a run that goes on into the next text is two
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(covered))]
    inner = np.unique(inner[covered[inner] & covered[inner - 1]])
    start, end = np.sort(np.concatenate((start, inner))), np.sort(np.concatenate((end, inner)))
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start - offsets[row], end - offsets[row]


REPORT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def _scoped(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lit(0).cast("long").alias("scope"), F.col(f"`{text_col}`").alias("text"), *more)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null text is empty. Rows of one id are one document to each other: neither is smaller. A null id is larger than all ids and
    removes nothing elsewhere. Texts shorter than ``min_len`` keep every byte. Extra columns are passed over.
    """
    schema = T.StructType([T.StructField(id_col, T.LongType()), *REPORT])

    def finish(table, text, offsets, covered):
        removed = np.concatenate(([0], np.cumsum(covered)))
        row, _, _ = spans_of(covered, offsets)
        kept, raw = ~covered, []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            raw.append(hashlib.sha256(text[a:b][kept[a:b]].tobytes()).hexdigest())
        n = table.num_rows
        return pa.table([table["id"], pa.array(np.diff(offsets)), pa.array(removed[offsets[1:]] - removed[offsets[:-1]]), pa.array(np.bincount(row, minlength=n)), pa.array(raw, pa.string())], names=schema.names)

    return cover(_scoped(docs, id_col, text_col), finish, schema, **options)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated passages removed from the text; characters that a cut would split go as a whole. Columns as in ``docs``."""
    # the text travels once, beside the other columns
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row"), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    out_type = T.StructType([carried.schema["row"], T.StructField("text", T.StringType())])

    def finish(table, text, offsets, covered):
        kept, out = ~covered, []
        null = np.asarray(pc.is_null(table["text"]))
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            out.append(None if null[k] else text[a:b][kept[a:b]].tobytes().decode("utf-8", "ignore"))
        return pa.table([table["row"], pa.array(out, pa.string())], names=["row", "text"])

    found = cover(_scoped(carried, id_col, text_col, "row"), finish, out_type, **options)
    return C.new_length(found.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns)), text_col)


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
