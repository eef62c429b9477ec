"""Language-model scores from Elias-Fano n-gram tries.

The corpus's training part gives counts of words and n-grams; a shard keeps its n-grams in a trie whose levels are monotone sequences
(word ids offset by their parent) and monotone pointers in Elias-Fano form, with quantised log-probabilities at the last level. Levels
lie in one file in the shared folder and are memory-mapped where that folder is a mounted one. A lookup is a successor search
among the successors of its context.

p(w | u) = (P(u w) + m p(w)) / (P(u) + m), m = PRIOR / N: joint probabilities from the trie, and from the next lower order the rest;
the lowest order is (c + 1) / (N + V + 1), which leaves one share to unknown words. Contexts do not cross texts.

How it scales: batches of texts send each shard the distinct words, then the distinct n-grams, that they hold, and get ids, counts
and codes back; both are aggregated before they move. An n-gram's shard depends on its context and on eight classes of its last
word, so a context that a third of all text has is spread too. Model and messages grow with the corpus and are never at one place.

Defined results: a null or empty text has the end token alone; a null id is in the training part; repeated rows each count and score by
themselves; extra columns are passed over; without training rows all counts are zero.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.llm import common as C
from galleyproof.llm.tokenfile import file_system

ORDER, PRIOR = 2, 8.0
FOLDS, HELD_OUT = 7, 2
#: Codes: 1 + STEPS * log2(count); 0 is absent.
STEPS = 1024
SHARDS_PER_PARTITION = 4
SPREAD = 8

ROW = T.StructType([T.StructField("batch", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("body", T.BinaryType())])
NAMES = ROW.names
BATCH, WORDS, IDS, GRAMS, CODES, TOKENS, VOCABULARY = range(7)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes under zstandard."""
    head = [(a.dtype.str, len(a)) for a in arrays]
    planes = [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes() for a in arrays]
    return zstandard.compress(repr(head).encode() + b"\n" + b"".join(planes), 1)


def unpack(body: bytes) -> list[np.ndarray]:
    import ast

    raw = zstandard.decompress(body)
    at = raw.index(b"\n") + 1
    out = []
    for kind, n in ast.literal_eval(raw[: at - 1].decode()):
        dtype = np.dtype(kind)
        part = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at)
        out.append(part.reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, select by popcount blocks. Works on (mapped) byte buffers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        spread = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.zeros(-(-n * bits // 64) * 8 + 16, np.uint8)
        packed = np.packbits(spread.reshape(-1), bitorder="little")
        low[: len(packed)] = packed
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (universe >> bits) + n + 2
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[place] = 1
        return EliasFano(n, bits, low.view(np.uint64), np.packbits(unary, bitorder="little").view(np.uint64))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > np.uint64(64)
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & ((np.uint64(1) << np.uint64(self.low_bits)) - np.uint64(1)) if self.low_bits < 64 else value

    @staticmethod
    def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one (from 0) of each word: halving by popcounts."""
        at = np.zeros(len(word), np.uint64)
        k = k.astype(np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((word >> at) & np.uint64((1 << half) - 1)).astype(np.int64)
            right = k >= count
            k = np.where(right, k - count, k)
            at = np.where(right, at + np.uint64(half), at)
        return at.astype(np.int64)

    def _select1(self, k: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.ones, k, side="right") - 1
        return block * 64 + self._in_word(self.high[block], k - self.ones[block])

    def _select0(self, k: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.zeros, k, side="right") - 1
        return block * 64 + self._in_word(~self.high[block], k - self.zeros[block])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (((self._select1(at) - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(at)).astype(np.int64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Place of each value, or -1: the successor of the value among elements of its high part."""
        value = value.astype(np.uint64)
        high = (value >> np.uint64(self.low_bits)).astype(np.int64)
        low = value & ((np.uint64(1) << np.uint64(self.low_bits)) - np.uint64(1))
        begin = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) + 1 - high, 0)
        end = self._select0(high) - high
        stop = end.copy()
        while True:
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                break
            middle = (begin[open_] + end[open_]) >> 1
            less = self._lows(middle) < low[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
        hit = np.flatnonzero(begin < stop)
        same = self._lows(begin[hit]) == low[hit]
        out = np.full(len(value), -1, np.int64)
        out[hit[same]] = begin[hit[same]]
        return out


class Trie:
    """n-grams of one length. Level j holds word + parent * universe; the last level has the codes."""

    def __init__(self, levels: list[EliasFano], pointers: list[EliasFano], universe: int, codes: np.ndarray):
        self.levels, self.pointers, self.universe, self.codes = levels, pointers, universe, codes

    @staticmethod
    def build(grams: list[np.ndarray], counts: np.ndarray) -> Trie:
        """``grams``: a column for each word, rows sorted and distinct."""
        universe = int(max(int(g.max()) for g in grams)) + 1
        parent = np.zeros(len(counts), np.int64)
        levels, pointers = [], []
        for j, column in enumerate(grams):
            key = parent * universe + column.astype(np.int64)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            values = key[new]
            parents = int(parent[-1]) + 1
            levels.append(EliasFano.build(values, parents * universe))
            if j:
                # where each parent's successors begin, and the end
                begin = np.append(np.searchsorted(values, np.arange(parents) * universe), len(values))
                pointers.append(EliasFano.build(begin, len(values) + 1))
            parent = np.cumsum(new) - 1
        return Trie(levels, pointers, universe, quantise(counts))

    def find(self, grams: list[np.ndarray]) -> np.ndarray:
        """Codes of the n-grams, level by level: the word's successor search within its context's range."""
        out = np.zeros(len(grams[0]), np.uint16)
        open_ = np.arange(len(out))
        node = np.zeros(len(out), np.int64)
        for j, column in enumerate(grams):
            word = column[open_].astype(np.int64)
            inside = word < self.universe
            if j:
                inside &= self.pointers[j - 1][node] < self.pointers[j - 1][node + 1]
            open_, word, node = open_[inside], word[inside], node[inside]
            place = self.levels[j].find(node * self.universe + word)
            open_, node = open_[place >= 0], place[place >= 0]
        out[open_] = self.codes[node]
        return out

    def save(self, uri: str) -> None:
        sequences = [*self.levels, *self.pointers]
        head = np.array([len(self.levels), self.universe, len(self.codes), *(x for s in sequences for x in (s.n, s.low_bits, len(s.low), len(s.high)))], np.int64)
        fs, path = file_system(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path, compression=None) as out:
            out.write(np.int64(len(head)).tobytes() + head.tobytes())
            for s in sequences:
                out.write(s.low.tobytes())
                out.write(s.high.tobytes())
            palette, at = np.unique(self.codes, return_inverse=True)
            small = len(palette) <= 256
            out.write(np.int64(len(palette) if small else 0).tobytes())
            out.write(palette.tobytes() + at.astype(np.uint8).tobytes() if small else self.codes.tobytes())

    @staticmethod
    def open(uri: str) -> Trie:
        """Memory-mapped where the file system is local or mounted, else read."""
        fs, path = file_system(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            raw = pa.memory_map(path).read_buffer()
        else:
            with fs.open_input_file(path) as f:
                raw = f.read_buffer()
        head = np.frombuffer(raw, np.int64, int(np.frombuffer(raw, np.int64, 1)[0]), 8)
        at, order = 8 + head.nbytes, int(head[0])
        sequences = []
        for n, bits, low, high in head[3:].reshape(-1, 4).tolist():
            a = np.frombuffer(raw, np.uint64, low, at)
            b = np.frombuffer(raw, np.uint64, high, at + 8 * low)
            sequences.append(EliasFano(n, bits, a, b))
            at += 8 * (low + high)
        colours = int(np.frombuffer(raw, np.int64, 1, at)[0])
        if colours:
            palette = np.frombuffer(raw, np.uint16, colours, at + 8)
            codes = palette[np.frombuffer(raw, np.uint8, int(head[2]), at + 8 + 2 * colours)]
        else:
            codes = np.frombuffer(raw, np.uint16, int(head[2]), at + 8)
        return Trie(sequences[:order], sequences[order:], int(head[1]), codes)


def quantise(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.round(STEPS * np.log2(np.maximum(counts, 1))), 0).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2((codes.astype(np.float64) - 1) / STEPS), 0.0)


def _ranges(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of runs in a sorted array."""
    cut = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
    return [(int(shard[a]), a, b) for a, b in zip(cut, [*cut[1:], len(shard)][: len(cut)], strict=True)]


def _table(batch, kind: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    n = len(rows)
    return pa.table([pa.array([batch] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=NAMES)


def _first(docs: DataFrame, shards: int, chunk: int) -> DataFrame:
    """Batch rows (ids, fold, tokens as numbers of distinct words) and, for each shard, the batch's distinct words with training counts."""

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for table in C.chunked(batches, "text", chunk):
            number = (task << 24) + k
            k += 1
            data, offsets = C.flat_text(table["text"])
            words, row = C.split_words(data.tobytes().translate(C.FOLD_TABLE), offsets)
            n = table.num_rows
            coded = words.dictionary_encode() if len(words) else None
            distinct = [b"", *(coded.dictionary.cast(pa.large_binary()).to_pylist() if coded is not None else [])]
            at = np.asarray(coded.indices, dtype=np.int64) + 1 if coded is not None else np.zeros(0, np.int64)
            size = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
            tokens = np.insert(at, np.cumsum(size), 0).astype(np.uint32)
            size = size + 1
            held = np.asarray(table["held_out"])
            train = np.bincount(tokens[np.repeat(~held, size)], minlength=len(distinct))
            ids = pa.table({"id": table["id"]})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as stream:
                stream.write_table(ids)
            shard = np.fromiter((zlib.crc32(w) % shards for w in distinct), np.int64, len(distinct))
            yield from _table(number, BATCH, [(0, pack(np.frombuffer(sink.getvalue(), np.uint8), held.astype(np.uint8), size.astype(np.uint32), tokens, shard.astype(np.uint32)))]).to_batches()
            order = np.argsort(shard, kind="stable")
            out = []
            for s, a, b in _ranges(shard[order]):
                part = [distinct[i] for i in order[a:b].tolist()]
                length = np.array([len(w) for w in part], np.uint32)
                out.append((s, pack(length, np.frombuffer(b"".join(part), np.uint8), train[order[a:b]].astype(np.int64))))
            yield from _table(number, WORDS, out).to_batches()

    return C.settle(C.narrow_batches(docs).mapInArrow(run, ROW))


def _number_words(table: pa.Table) -> pa.Table:
    """A shard's words get ranks (frequent ones small ones) and counts; each batch its answer; and the shard its totals.

    A word's id is its rank times the number of shards, plus its shard.
    """
    own = int(table["shard"][0].as_py())
    place: dict[bytes, int] = {}
    parts, counts = [], []
    for body in table["body"].to_pylist():
        length, data, count = unpack(body)
        raw, at, mine = data.tobytes(), 0, np.empty(len(length), np.int64)
        for k, size in enumerate(length.tolist()):
            mine[k] = place.setdefault(raw[at : at + size], len(place))
            at += size
        parts.append(mine)
        counts.append(count)
    total = np.bincount(np.concatenate(parts), weights=np.concatenate(counts), minlength=len(place)).astype(np.int64)
    rank = np.empty(len(place), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(place))
    rows = [pack(rank[m].astype(np.uint64), total[m]) for m in parts]
    out = pa.table([table["batch"], pa.array([IDS] * len(rows), pa.int32()), table["shard"], pa.array(rows, pa.binary())], names=NAMES)
    # the totals stand in the batch column
    return pa.concat_tables([out, _table(int(total.sum()), TOKENS, [(own, b"")]), _table(int((total > 0).sum()), VOCABULARY, [(own, b"")])])


class _Batch:
    def __init__(self, table: pa.Table, shards: int):
        answers: dict[int, list] = {IDS: [], CODES: []}
        for number, kind, shard, body in zip(*(table[c].to_pylist() for c in NAMES), strict=True):
            self.number = number
            if kind == BATCH:
                ids, held, size, self.tokens, word_shard = unpack(body)
                self.ids = pa.ipc.open_stream(pa.py_buffer(ids.tobytes())).read_all()["id"]
                self.held, self.size = held.astype(bool), size.astype(np.int64)
            else:
                answers[kind].append((shard, body))
        order = np.argsort(word_shard, kind="stable")
        self.word_id, self.word_count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        answered = dict(answers[IDS])
        for s, a, b in _ranges(word_shard[order].astype(np.int64)):
            rank, counts = unpack(answered[s])
            self.word_id[order[a:b]] = rank.astype(np.int64) * shards + s
            self.word_count[order[a:b]] = counts
        self.codes = dict(answers[CODES])
        self.end = np.cumsum(self.size)

    def grams(self, order: int, shards: int):
        """For each length: distinct n-grams (columns of word ids), training counts, shard; and each position's n-gram, or -1."""
        tokens, n_words = self.tokens.astype(np.int64), max(1, len(self.word_id))
        depth = np.arange(len(tokens)) - np.repeat(self.end - self.size, self.size)
        train = np.repeat(~self.held, self.size)
        node, columns = tokens, [self.word_id]
        for length in range(2, order + 1):
            at = np.flatnonzero(depth >= length - 1)
            pair = node[at - 1] * n_words + tokens[at]
            distinct, back = np.unique(pair, return_inverse=True)
            counts = np.bincount(back, weights=train[at], minlength=len(distinct)).astype(np.int64)
            context, last = distinct // n_words, distinct % n_words
            columns = [c[context] for c in columns] + [self.word_id[last]]
            mix = np.zeros(len(distinct), np.uint64)
            for c in columns[:-1]:
                mix = (mix + c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                mix ^= mix >> np.uint64(29)
            mix = (mix + (columns[-1] % SPREAD).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            shard = ((mix >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            where = np.full(len(tokens), -1, np.int64)
            where[at] = back
            yield length, columns, counts, shard, where
            node = np.full(len(tokens), -1, np.int64)
            node[at] = back

    def sent(self, columns, shard) -> np.ndarray:
        """The order n-grams are sent in: by shard, then by words."""
        return np.lexsort((*columns[::-1], shard))


def _send_grams(table: pa.Table, order: int, shards: int) -> pa.Table:
    batch = _Batch(table, shards)
    out = []
    for length, columns, counts, shard, _ in batch.grams(order, shards):
        by = batch.sent(columns, shard)
        wide = np.uint32 if max((int(c.max(initial=0)) for c in columns), default=0) < 1 << 32 else np.uint64
        for s, a, b in _ranges(shard[by]):
            part = by[a:b]
            first = columns[0][part]
            out.append((s * ORDER_SLOTS + length, pack(np.diff(first, prepend=0).astype(wide), *(c[part].astype(wide) for c in columns[1:]), counts[part].astype(np.uint32))))
    return _table(batch.number, GRAMS, out)


#: Lengths share the shard number's low digits.
ORDER_SLOTS = 8


def _answer_grams(table: pa.Table, folder: str) -> pa.Table:
    """Merge a shard's n-grams of one length, build and save its trie, and look every batch's n-grams up in it."""
    slot = int(table["shard"][0].as_py())
    bodies = []
    for body in table["body"].to_pylist():
        first, *rest, counts = unpack(body)
        bodies.append(([np.cumsum(first.astype(np.int64)), *(c.astype(np.int64) for c in rest)], counts.astype(np.int64)))
    columns = [np.concatenate(c) for c in zip(*(b[0] for b in bodies), strict=True)]
    counts = np.concatenate([b[1] for b in bodies])
    seen = counts > 0
    columns, counts = [c[seen] for c in columns], counts[seen]
    if not len(counts):
        rows = [pack(np.zeros(len(b[1]), np.uint16)) for b in bodies]
    else:
        by = np.lexsort(columns[::-1])
        columns, counts = [c[by] for c in columns], counts[by]
        new = np.ones(len(counts), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        total = np.add.reduceat(counts, np.flatnonzero(new))
        uri = f"{folder}/{slot % ORDER_SLOTS}-grams/{slot // ORDER_SLOTS:06d}-{TaskContext.get().taskAttemptId()}.trie"
        Trie.build([c[new] for c in columns], total).save(uri)
        trie = Trie.open(uri)
        rows = [pack(trie.find(b[0])) for b in bodies]
    return pa.table([table["batch"], pa.array([CODES] * len(rows), pa.int32()), table["shard"], pa.array(rows, pa.binary())], names=NAMES)


OUT = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


def _score(table: pa.Table, order: int, shards: int, n_train: int, n_words: int, names: list[str]) -> pa.Table:
    batch = _Batch(table, shards)
    tokens = batch.tokens.astype(np.int64)
    count = batch.word_count[tokens] if len(tokens) else np.zeros(0, np.int64)
    base = (count + 1.0) / (n_train + n_words + 1.0)
    p = base.copy()
    context = np.append(0.0, count[:-1].astype(np.float64))  # how often the context occurs
    for length, columns, _, shard, where in batch.grams(order, shards):
        by = batch.sent(columns, shard)
        codes = np.zeros(len(by), np.uint16)
        for s, a, b in _ranges(shard[by]):
            codes[by[a:b]] = unpack(batch.codes[s * ORDER_SLOTS + length])[0]
        joint = np.where(where >= 0, restore(codes)[np.maximum(where, 0)], 0.0) if len(codes) else np.zeros(len(tokens))
        use = where >= 0
        p[use] = (joint[use] + PRIOR * p[use]) / (np.maximum(context[use], joint[use]) + PRIOR)
        context = np.append(0.0, joint[:-1])
    begin = batch.end - batch.size
    total = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)
    known = total((count > 0).astype(np.int64)).astype(np.int64)
    return pa.table([batch.ids, pa.array(batch.held), pa.array(batch.size), pa.array(known), pa.array(np.full(len(begin), n_train)), pa.array(total(np.log10(base))), pa.array(total(np.log10(p)))], names=names)


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk: int | None = None, folder: str | None = None) -> DataFrame:
    """Train on the rows where ``held_out`` (a column) is false, score all. Saves the tries below ``folder`` (a new one by default)."""
    spark = docs.sparkSession
    shards = SHARDS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or f"{C.checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    chunk = chunk or int(min(48 << 20, max(8 << 20, shards * (16 << 10))))
    first = _first(rows, shards, chunk)
    numbered = C.settle(first.filter(F.col("kind") == WORDS).groupBy("shard").applyInArrow(_number_words, ROW))
    totals = numbered.filter(F.col("kind").isin(TOKENS, VOCABULARY)).groupBy("kind").agg(F.sum("batch")).collect()
    n_train, n_words = (dict(map(tuple, totals)).get(k, 0) for k in (TOKENS, VOCABULARY))
    known = first.filter(F.col("kind") == BATCH).unionAll(numbered.filter(F.col("kind") == IDS))
    codes = known.groupBy("batch").applyInArrow(lambda t: _send_grams(t, order, shards), ROW).groupBy("shard").applyInArrow(lambda t: _answer_grams(t, folder), ROW)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *(T.StructField(n, t) for n, t in OUT)])
    return known.unionAll(codes).groupBy("batch").applyInArrow(lambda t: _score(t, order, shards, n_train, n_words, schema.names), schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out())
