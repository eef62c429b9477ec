"""Benchmark decontamination by FM-index.

Each chunk of documents (a shard) gets an FM-index of its own: a wavelet matrix over the Burrows-Wheeler transform of the
shard's words and a sampled suffix array. All benchmark phrases are searched backwards at once through wavelet ranks, their
occurrences are located from the sampled suffix positions, and the covered words are merged into removal spans.

The shard text is projected on the benchmark's vocabulary first: a word that no phrase holds cannot lie in an occurrence, so
only maximal runs of phrase words, at least as long as the shortest phrase, enter the index. No occurrence is lost by that.

Defined results: a null or word-less text has no words and no hit; a null or word-less item has no window; repeated items and
repeated documents each count by themselves, repeated item ids (null ones too) as one item, and a null id adds nothing to the joined ids;
a null document id is passed on; an empty benchmark leaves every document clean; extra columns are passed over.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.llm import common as C

#: Words of a window.
WINDOW = 10
#: Benchmark text that one search block holds; a larger benchmark is searched block after block over the same rows.
BLOCK_BYTES = 8 << 20
SAMPLE_RATE = 16

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by rank doubling (a suffix that ends first sorts first)."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        placed = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(placed[1:] != placed[:-1])))
        rank = fresh
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order if rank[order[-1]] == n - 1 else np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Bit planes, most significant first, with popcount blocks of 64: ``rank`` in a step per plane."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        now = symbols.astype(np.int64)
        for plane in range(self.bits - 1, -1, -1):
            bit = ((now >> plane) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            padded[: len(packed)] = packed
            words = padded.view(np.uint64)
            self.words.append(words)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``."""
        start = np.zeros_like(at)
        for level, plane in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> plane) & 1).astype(bool)
            first, last = self._rank1(level, start), self._rank1(level, at)
            start = np.where(one, self.zeros[level] + first, start - first)
            at = np.where(one, self.zeros[level] + last, at - last)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for level in range(self.bits):
            word = self.words[level][at >> 6]
            one = ((word >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._rank1(level, at)
            at = np.where(one == 1, self.zeros[level] + ones, at - ones)
            symbol = symbol * 2 + one
        return symbol


class FMIndex:
    """Over symbols 1 .. sigma-1; symbol 0 is the end of the text."""

    def __init__(self, symbols: np.ndarray, sigma: int, rate: int = SAMPLE_RATE):
        text = np.append(symbols, 0)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.tree = WaveletMatrix(bwt, sigma)
        sampled = order % rate == 0
        self.sample_row = np.flatnonzero(sampled)
        self.sample_at = order[sampled]
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns (one per row of the matrix), all backwards at once."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, column]
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
            high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions: walk back from each row to a sampled one."""
        found = np.full(len(rows), -1, np.int64)
        now, open_, steps = rows.copy(), np.arange(len(rows)), 0
        while len(open_):
            at = np.searchsorted(self.sample_row, now)
            hit = (at < len(self.sample_row)) & (self.sample_row[np.minimum(at, len(self.sample_row) - 1)] == now)
            found[open_[hit]] = self.sample_at[at[hit]] + steps
            open_, now = open_[~hit], now[~hit]
            symbol = self.tree.access(now)
            now = self.first[symbol] + self.tree.rank(symbol, now)
            steps += 1
        return found


class Phrases:
    """Distinct windows of a block of benchmark items, and which items hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        ids: dict[bytes, int] = {}
        distinct: dict[tuple[int, ...], int] = {}
        self.holders: list[list[str]] = []
        for item, text in items:
            words = [ids.setdefault(w, len(ids)) for w in _WORD.findall((text or "").encode().translate(C.FOLD_TABLE))]
            for start in range(max(1, len(words) - window + 1) if words else 0):
                at = distinct.setdefault(tuple(words[start : start + window]), len(distinct))
                if at == len(self.holders):
                    self.holders.append([])
                if item not in self.holders[at]:
                    self.holders[at].append(item)
        self.words = pa.array([w for w in ids], pa.large_binary())
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        grouped: dict[int, list] = defaultdict(list)
        for phrase, at in distinct.items():
            grouped[len(phrase)].append((at, phrase))
        for size, rows in grouped.items():
            self.by_length[size] = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64) + 2)
        self.shortest = min(self.by_length, default=0)


def occurrences(phrases: Phrases, words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first word, length) of every occurrence in a shard's words; occurrences do not cross rows."""
    nothing = (np.zeros(0, np.int64),) * 3
    if not len(words) or not phrases.shortest:
        return nothing
    known = np.asarray(pc.fill_null(pc.index_in(words.cast(pa.large_binary()), value_set=phrases.words), -1), dtype=np.int64)
    inside = known >= 0
    edge = np.ones(len(known), bool)
    edge[1:] = (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, len(known)))
    use = inside[starts] & (sizes >= phrases.shortest)
    starts, sizes = starts[use], sizes[use]
    if not len(starts):
        return nothing
    at = C.ragged(starts, sizes)
    place = np.arange(len(at)) + np.repeat(np.arange(len(starts)), sizes)
    symbols = np.ones(len(at) + len(starts) - 1, np.int64)
    symbols[place] = known[at] + 2
    back = np.full(len(symbols), -1, np.int64)
    back[place] = at
    index = FMIndex(symbols, len(phrases.words) + 2)
    found = []
    for size, (which, patterns) in phrases.by_length.items():
        low, high = index.search(patterns)
        hit = high > low
        rows = C.ragged(low[hit], (high - low)[hit])
        spot = back[index.locate(rows)]
        found.append((np.repeat(which[hit], (high - low)[hit]), spot, np.full(len(spot), size)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    spans: list[dict] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if spans and s <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], e)
        else:
            spans.append({"start": s, "end": e})
    return spans


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
    """The benchmark's items in blocks of bounded size, streamed through the driver one block at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs``' id and text with n_words, spans (merged removal spans in words) and items (ids of items with occurring windows).

    One narrow map per benchmark block; documents are never shuffled.
    """
    out = C.own_columns(docs, id_col, text_col).toDF("id", "text").selectExpr("id", "text", "0L AS n_words")
    out = out.withColumn("spans", F.array().cast(SPAN)).withColumn("items", F.array().cast("array<string>"))
    schema = out.schema
    blocks = 0
    for block in item_blocks(benchmark, item_id, item_text, block_bytes):
        out = _pass(out, Phrases(block, window), schema)
        blocks += 1
    if not blocks:
        out = _pass(out, Phrases([], window), schema)
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def _pass(df: DataFrame, phrases: Phrases, schema: T.StructType) -> DataFrame:
    return C.map_chunks(df, lambda: lambda table: _search(table, phrases), schema)


def _search(table: pa.Table, phrases: Phrases) -> pa.Table:
    data, offsets = C.flat_text(table["text"])
    words, row = C.split_words(data.tobytes().translate(C.WORD_TABLE), offsets)
    n = table.num_rows
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    phrase, start, size = occurrences(phrases, words, row)
    spans, items = table["spans"].to_pylist(), table["items"].to_pylist()
    of = row[start]
    for i in np.unique(of).tolist():
        mine = of == i
        s = start[mine] - first[i]
        old = spans[i]
        spans[i] = merged(np.concatenate((s, [x["start"] for x in old])).astype(np.int64), np.concatenate((s + size[mine], [x["end"] for x in old])).astype(np.int64))
        items[i] = sorted({x for p in set(phrase[mine].tolist()) for x in phrases.holders[p]} | set(items[i]), key=lambda x: (x is None, x or ""))
    schema = table.schema
    return pa.table([table["id"], table["text"], pa.array(counts, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(items, schema.field("items").type)], schema=schema)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, a digest of the items hit, and whether it is contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return found.select(
        F.col(id_col),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut_text(text: str | None, spans) -> str | None:
    """``text`` without the bytes from the first to the last word of each span; each cut leaves a line break."""
    if not spans or text is None:
        return text
    raw = text.encode()
    words = [m.span() for m in _WORD.finditer(raw.translate(C.FOLD_TABLE))]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    return b"\n".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """``docs`` with every occurring benchmark window cut out of the text; clean documents stay as they are. Columns as in ``docs``."""
    packed = docs.select(F.struct("*").alias("id"), F.col(text_col).alias("text"))
    found = find_spans(packed, benchmark, "id", "text", **names)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: cut_text(t, list(s)))

    text = F.when(F.size("spans") > 0, cut("text", "spans")).otherwise(F.col("text"))
    out = found.withColumn("cut", text).select(*(F.col("cut").alias(c) if c == text_col else F.col(f"id.`{c}`").alias(c) for c in docs.columns))
    return C.new_length(out, text_col)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return report(find_spans(docs, items))
