"""Piece encoding and decoding by suffix-array matching.

Texts are cut where no piece can reach across: a merge makes a piece, so two neighbouring characters that stand in no piece together
stay apart. A batch's distinct stretches are concatenated and their suffixes sorted (to the length of the longest piece); every piece is
binary-searched for its range of suffixes, all pieces at once; the ranges are the edges of the segmentation lattice. Edges are
sorted by position and relaxed in that order.

The vocabulary is of the byte-pair kind. There, a segmentation is the one that merging would give exactly if every piece and every
two neighbours, merged anew, come out as they are; and each prefix has one such segmentation. So relaxing an edge means: keep it
if its piece may stand behind the last piece of the prefix where it starts. The ids are those of the sentencepiece library.

Stretches a worker has met before are not matched again: two generations of at most CACHE_BYTES each are held; ids do not depend on it.

Defined results: null and empty texts give no ids and decode to the empty text; characters that no piece spells are given byte by
byte; repeated rows each give their own row; extra columns are passed over.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from galleyproof.llm import common as C
from galleyproof.llm import pieces as P

#: Bytes of a generation of known stretches (an entry counts ENTRY besides its text and ids).
CACHE_BYTES, ENTRY = 40 << 20, 200
#: Slots of the table of judged neighbours, as a power of two.
FIT_BITS = 20
#: Text bytes that are coded at a time, bytes of new stretches that are matched at a time, and id lists that are decoded at a time.
#: Bounds on memory; results do not depend on them.
MATCH_BYTES, WORD_BYTES, DECODE_ROWS = 4 << 20, 1 << 19, 512
BREAK = b"\xff"


class Codec:
    def __init__(self, vocabulary: P.Vocabulary):
        self.vocab = vocabulary
        self.pieces = {p.replace(P.SPACE, P.GAP): i for p, i in vocabulary.pieces.items()}
        self.scores = {p: float(vocabulary.scores[i]) for p, i in self.pieces.items()}
        self.spelling = {i: p for p, i in self.pieces.items()}
        own = [(p.encode(), i, len(p)) for p, i in self.pieces.items() if self.merge(p) == [p]]
        # long pieces last: only they need more than the first eight bytes
        own.sort(key=lambda x: len(x[0]) > 8)
        self.short = sum(len(b) <= 8 for b, _, _ in own)
        self.longest = -(-max(len(b) for b, _, _ in own) // 8) * 8
        self.piece_ids = np.array([i for _, i, _ in own], np.int64)
        self.piece_bytes = np.array([len(b) for b, _, _ in own], np.int64)
        self.piece_chars = np.array([n for _, _, n in own], np.int64)
        self.low_key = self._keys([b for b, _, _ in own], b"\x00")
        self.high_key = self._keys([b for b, _, _ in own], b"\xff")
        self.fit_pair, self.fit_answer = np.full(1 << FIT_BITS, -1, np.int64), np.zeros(1 << FIT_BITS, bool)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _keys(self, pieces: list[bytes], fill: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(p.ljust(self.longest, fill) for p in pieces), ">u8").reshape(len(pieces), -1).astype(np.uint64)

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while True:
            best, where = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, k
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def merge_long(self, text: str) -> list[str]:
        """As ``merge``, with the neighbours in a heap: n log n steps, so that one rule serves every length."""
        parts, scores, n = list(text), self.scores, len(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, k, 2) for k in range(n - 1) if (s := scores.get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            follow = right[k]
            # an entry is stale where either side was merged since
            if not parts[k] or follow == n or len(parts[k]) + len(parts[follow]) != size:
                continue
            parts[k] += parts[follow]
            parts[follow] = ""
            after = right[k] = right[follow]
            if after < n:
                left[after] = k
            for a, b in ((left[k], k), (k, after)):
                if a >= 0 and b < n:
                    score = scores.get(parts[a] + parts[b])
                    if score is not None:
                        heapq.heappush(heap, (-score, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p]

    def fits(self, pair: np.ndarray) -> np.ndarray:
        """Whether two pieces (left << 20 | right) stay apart when merged anew."""
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FIT_BITS)).astype(np.int64)
        answer = self.fit_answer[slot]
        fresh = np.flatnonzero(self.fit_pair[slot] != pair)
        if len(fresh):
            distinct, first, back = np.unique(pair[fresh], return_index=True, return_inverse=True)
            spelling, merge = self.spelling, self.merge
            found = np.empty(len(distinct), bool)
            for k, p in enumerate(distinct.tolist()):
                a, b = spelling[p >> 20], spelling[p & 0xFFFFF]
                found[k] = merge(a + b) == [a, b]
            answer[fresh] = found[back]
            put = slot[fresh[first]]
            self.fit_pair[put], self.fit_answer[put] = distinct, found
        return answer

    def _suffixes(self, text: np.ndarray, starts: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Character starts sorted by the bytes behind them up to the stretch's end (``longest`` at most), their first eight, and the eight at each text byte."""
        padded = np.concatenate((text, np.zeros(self.longest + 8, np.uint8)))
        words = np.ndarray((len(text) + self.longest,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
        # what follows a stretch's end counts as zero
        key = words[starts]
        cut = np.flatnonzero(room < 7)
        key[cut] &= ~((np.uint64(1) << ((7 - room[cut]) * 8).astype(np.uint64)) - np.uint64(1))
        by = np.argsort(key, kind="stable")
        ranked = key[by]
        depth = 8
        tied = np.zeros(len(by), bool)
        tied[1:] = ranked[1:] == ranked[:-1]
        while depth < self.longest:
            # runs of equal suffixes that reach further are sorted by their next eight bytes
            inside = tied.copy()
            inside[:-1] |= tied[1:]
            at = np.flatnonzero(inside & (room[by] >= depth))
            if not len(at):
                break
            run = np.cumsum(~tied)[at]
            left = room[by[at]] - depth
            following = words[starts[by[at]] + depth]
            short = np.flatnonzero(left < 7)
            following[short] &= ~((np.uint64(1) << ((7 - left[short]) * 8).astype(np.uint64)) - np.uint64(1))
            order = np.lexsort((following, run))
            by[at] = by[at[order]]
            following = following[order]
            same = np.zeros(len(at), bool)
            same[1:] = (run[1:] == run[:-1]) & (following[1:] == following[:-1])
            tied[:] = False
            tied[at] = same
            depth += 8
        return starts[by], ranked, words

    def _narrow(self, order: np.ndarray, words: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of long pieces inside the range of their first eight bytes."""
        which = np.flatnonzero(low < high)
        while len(which):
            middle = (low[which] + high[which]) >> 1
            at = order[middle]
            below = np.full(len(which), upper)
            open_ = np.arange(len(which))
            for w in range(1, keys.shape[1]):
                have, want = words[at[open_] + 8 * w], keys[which[open_], w]
                below[open_[have < want]] = True
                below[open_[have > want]] = False
                open_ = open_[have == want]
                if not len(open_):
                    break
            low[which[below]] = middle[below] + 1
            high[which[~below]] = middle[~below]
            which = which[low[which] < high[which]]
        return low

    def edges(self, text: np.ndarray, starts: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end byte, piece) of every occurrence of every piece; ``room`` is the distance of each start to its stretch's end."""
        order, lead, words = self._suffixes(text, starts, room)
        k = self.short
        low = np.searchsorted(lead, self.low_key[:, 0], side="left")
        high = np.searchsorted(lead, self.high_key[:, 0], side="right")
        begin, end = low[k:].copy(), high[k:].copy()
        low[k:] = self._narrow(order, words, self.low_key[k:], begin.copy(), end.copy(), False)
        high[k:] = self._narrow(order, words, self.high_key[k:], begin, end, True)
        found = np.maximum(high - low, 0)
        hit = found > 0
        first = order[C.ragged(low[hit], found[hit])]
        which = np.repeat(np.flatnonzero(hit), found[hit])
        return first, first + self.piece_bytes[which], which

    def _match(self, words: list[str]) -> list[bytes]:
        """Ids of distinct stretches, as bytes of uint32."""
        joined = BREAK.join(w.encode() for w in words) + BREAK
        text = np.frombuffer(joined, np.uint8)
        stops = np.flatnonzero(text == 0xFF)
        begins = np.concatenate(([0], stops[:-1] + 1))
        word_at = np.repeat(np.arange(len(stops), dtype=np.int32), stops + 1 - begins)
        starts = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0xFF))
        first, end, which = self.edges(text, starts, stops[word_at[starts]] - starts)
        piece = self.piece_ids[which]
        # characters that no piece spells alone
        spelled = np.zeros(len(text) + 1, bool)
        spelled[first[self.piece_chars[which] == 1]] = True
        odd = starts[~spelled[starts]]
        if len(odd):
            lead = text[odd]
            width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            first, end, piece = np.concatenate((first, odd)), np.concatenate((end, odd + width)), np.concatenate((piece, np.full(len(odd), -1)))
        depth = end - begins[word_at[first]]
        order = np.argsort(depth, kind="stable")
        first, end, piece, depth = first[order], end[order], piece[order], depth[order]
        last = np.full(len(text) + 1, -2, np.int64)
        back = np.zeros(len(text) + 1, np.int64)
        last[begins] = -1
        bounds = np.flatnonzero(np.diff(depth, prepend=-1))
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(depth)], strict=True):
            f, p = first[a:b], piece[a:b]
            before = last[f]
            take = before > -2
            pair = take & (before >= 0) & (p >= 0)
            if pair.any():
                take[pair] = self.fits((before[pair] << 20) | p[pair])
            stop = end[a:b][take]
            last[stop] = p[take]
            back[stop] = f[take]
        # trace all stretches back at once
        at, of = stops.copy(), np.arange(len(stops))
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            going = at > begins[of]
            at, of = at[going], of[going]
            if not len(at):
                break
            seen.append((of, back[at], last[at]))
            at = back[at]
        if not seen:
            return [b""] * len(words)
        of, at, ids = (np.concatenate(x) for x in zip(*seen, strict=True))
        order = np.argsort(at, kind="stable")
        of, at, ids = of[order], at[order], ids[order]
        unknown = ids < 0
        if unknown.any():
            lead = text[at]
            size = np.where(unknown, np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))), 1)
            spread = C.ragged(at, size)
            ids = np.where(np.repeat(unknown, size), self.vocab.byte_ids[text[spread]], np.repeat(ids, size))
            of = np.repeat(of, size)
        flat = ids.astype("<u4").tobytes()
        stop = np.cumsum(np.bincount(of, minlength=len(words))) * 4
        return [flat[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        if self.held > CACHE_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        known, older = self.known, self.older
        new = [w for w in words if w not in known]
        found = [older.get(w) for w in new]
        fresh = [w for w, ids in zip(new, found, strict=True) if ids is None]
        known.update((w, ids) for w, ids in zip(new, found, strict=True) if ids is not None)
        # runs of spaces have equal scores, where the leftmost rule reaches across pieces: these few are merged plainly, at every length
        plain = [w for w in fresh if w.startswith(P.GAP * 3)]
        rest = [w for w in fresh if not w.startswith(P.GAP * 3)] if plain else fresh
        if rest:
            part = np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest))) // WORD_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(rest)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                known.update(zip(rest[a:b], self._match(rest[a:b]), strict=True))
        for w in plain:
            known[w] = self._plain(w)
        self.held += sum(len(w) + len(known[w]) + ENTRY for w in new)

    def encode(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of all texts, and each text's number of ids."""
        coded, row, _ = P.stretches(self.vocab, texts)
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        words, at = coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
        self._learn(words)
        blobs = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        ids = np.frombuffer(b"".join(blobs), "<u4")
        begin = np.cumsum(sizes) - sizes
        counts = np.bincount(row, weights=sizes[at], minlength=len(texts)).astype(np.int64)
        return ids[C.ragged(begin[at], sizes[at])], counts

    def _plain(self, word: str) -> bytes:
        ids: list[int] = []
        for part in self.merge_long(word):
            known = self.pieces.get(part)
            ids += [known] if known is not None else [int(self.vocab.byte_ids[b]) for b in part.encode()]
        return np.array(ids, "<u4").tobytes()


class Decoder:
    """Texts of ids; needs the pieces only, not the matching tables."""

    def __init__(self, vocabulary: P.Vocabulary):
        sizes = np.array([len(b) for b in vocabulary.output], np.int64)
        self.size, self.start = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(vocabulary.output), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of id lists; the space in front is taken off again."""
        size = self.size[ids]
        data = self.bytes[C.ragged(self.start[ids], size)].tobytes()
        total = np.concatenate(([0], np.cumsum(size)))
        stop = np.cumsum(counts)
        ends, begins = total[stop].tolist(), total[stop - counts].tolist()
        return [data[a + data.startswith(b" ", a, b) : b] for a, b in zip(begins, ends, strict=True)]


def codec(path: str) -> Codec:
    """One codec per worker and model."""
    return C.kept(("spcodec", path), lambda: Codec(P.vocabulary(path)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every row."""
    rows = C.own_columns(docs, id_col, text_col).toDF("id", "text")
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    @C.keeping
    def make():
        work = codec(model)

        def run(table: pa.Table) -> pa.Table:
            ids, counts = work.encode(table["text"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids.astype(np.int32)))
            return pa.table([table["id"], lists], names=schema.names)

        return run

    return C.map_chunks(rows, make, schema, target=MATCH_BYTES)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of every row."""
    rows = C.own_columns(encoded, id_col, ids_col).toDF("id", "ids")
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        work = Decoder(P.vocabulary(model))
        for whole in batches:
            for at in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(at, DECODE_ROWS)
                lists = pc.fill_null(batch.column("ids"), pa.scalar([], batch.column("ids").type))
                ids = np.asarray(lists.flatten(), dtype=np.int64)
                counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                stop = np.cumsum(counts) * 4
                sums = [zlib.crc32(raw[b - 4 * n : b]) for b, n in zip(stop.tolist(), counts.tolist(), strict=True)]
                texts = [t.decode("utf-8", "replace") for t in work.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(counts), pa.array(sums, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


TRIP = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("text_sha256", T.StringType())]


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_chars and text_sha256 of the decoded text: encoding and decoding in one worker."""
    rows = C.own_columns(docs, id_col, text_col).toDF("id", "text")
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *TRIP])

    @C.keeping
    def make():
        work, back = codec(model), Decoder(P.vocabulary(model))

        def run(table: pa.Table) -> pa.Table:
            ids, counts = work.encode(table["text"])
            raw, stop = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
            sums = [zlib.crc32(raw[b - 4 * n : b]) for b, n in zip(stop.tolist(), counts.tolist(), strict=True)]
            texts = [t.decode("utf-8", "replace") for t in back.decode(ids.astype(np.int64), counts)]
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            return pa.table([table["id"], pa.array(counts), pa.array(sums, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.string())], names=schema.names)

        return run

    return C.map_chunks(rows, make, schema, target=MATCH_BYTES)


def op10_sentencepiece_codec(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.default_model())
