"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a word embedding (hashed) beside its character embedding (mean and strongest of its hashed 5-byte grams). Both
tables carry, in their first column, smoothed log-odds from one half of the labelled sample; the rest, the two recurrences, the
attention and the output are trained by back-propagation through time on the other half. A text is read in overlapping windows
(WINDOW words, STRIDE apart, the last one ending with the text); every window is scored and the strongest decides. So each run of
WINDOW - STRIDE + 1 words lies whole in some window, wherever it stands.

Training reads at most ``max_docs`` labelled rows of at most ``max_chars`` characters, taken by a hash of their id, so the fit costs
the same at any size of the corpus. Scoring covers every window of every text in one narrow map.

Defined results: a null or word-less text is one window of no words; equal texts have equal scores; without any label of either kind
the scores are those of an untrained network with the known base rate; repeated rows each have their own row; extra columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.llm import common as C
from galleyproof.llm.induced import byte_words

WINDOW, STRIDE, HIDDEN, DIM = 32, 16, 8, 6
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 15
#: Bounds of the training sample.
MAX_DOCS, MAX_CHARS = 5000, 20_000
THRESHOLD = 0.3
#: Held out of training: ids whose crc32, as text, leaves this remainder.
FOLDS, HELD_OUT = 4, 2
BLOCK = 2048
EPOCHS, RATE = 4, 0.01


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


class Words:
    """A chunk's words: distinct ones as bucket ids, and which stands where."""

    def __init__(self, texts):
        data, offsets = C.flat_text(texts)
        words, row = C.split_words(data.tobytes().translate(C.WORD_TABLE), offsets)
        coded = words.dictionary_encode()
        self.rows = len(offsets) - 1
        self.at = np.asarray(coded.indices, dtype=np.int64) if len(words) else np.zeros(0, np.int64)
        self.counts = np.bincount(row, minlength=self.rows)
        distinct = coded.dictionary
        self.n = len(distinct)
        raw, at = C.flat_text(distinct)
        # "<word>": the bytes with marks on both sides, one after another
        size = np.diff(at) + 2
        begin = np.cumsum(size) - size
        text = np.full(int(size.sum()), 60, np.uint8)
        text[begin + size - 1] = 62
        text[C.ragged(begin + 1, size - 2)] = raw
        wide = byte_words(text, 8)[: len(text)]
        # the word's hash: its bytes as digits of a number modulo 2**64, mixed
        power = np.cumprod(np.full(len(text) + 1, 0x100000001B3, np.uint64))
        depth = np.arange(len(text)) - np.repeat(begin, size)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[depth], dtype=np.uint64)))
        h = total[begin + size] - total[begin]
        h ^= h >> np.uint64(31)
        self.word = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)
        grams = np.maximum(size - 4, 1)
        where = C.ragged(begin, grams)
        gram = wide[where] & np.uint64(0xFFFFFFFFFF)
        short = np.repeat(size < 5, grams)
        gram[short] &= np.uint64(0xFFFFFFFF)
        gram ^= gram >> np.uint64(21)
        self.gram = ((gram * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 15)).astype(np.int64)
        self.gram_begin, self.grams = np.cumsum(grams) - grams, grams

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of every window (the number of distinct words fills up), and each window's row."""
        per = np.where(self.counts <= WINDOW, 1, -(-(self.counts - WINDOW) // STRIDE) + 1)
        row = np.repeat(np.arange(self.rows), per)
        k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        first = np.cumsum(self.counts) - self.counts
        start = np.minimum(k * STRIDE, np.maximum(self.counts[row] - WINDOW, 0))
        place = start[:, None] + np.arange(WINDOW)
        inside = place < self.counts[row][:, None]
        flat = np.append(self.at, self.n)
        out = flat[np.where(inside, first[row][:, None] + place, len(self.at))]
        return out, row


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters, the forward pass, and its gradient."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        wide = 2 * DIM + 1
        f = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.word = (rng.normal(0, 0.1, (WORD_BUCKETS, DIM))).astype(np.float32)
        self.char = (rng.normal(0, 0.1, (CHAR_BUCKETS, DIM))).astype(np.float32)
        self.word[:, 0] = self.char[:, 0] = 0
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": f(wide, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": f(2 * HIDDEN, HIDDEN), "v": f(HIDDEN), "o": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}

    def inputs(self, words: Words, which: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of distinct words (all by default); a last row, for no word, is zero."""
        word, grams, begin, gram = words.word, words.grams, words.gram_begin, words.gram
        if which is not None:
            word, gram, grams = word[which], gram[C.ragged(begin[which], grams[which])], grams[which]
            begin = np.cumsum(grams) - grams
        x = np.zeros((len(word) + 1, 2 * DIM + 1), np.float32)
        if len(word):
            x[:-1, :DIM] = self.word[word]
            g = self.char[gram]
            x[:-1, DIM:-1] = np.add.reduceat(g, begin, axis=0) / grams[:, None]
            x[:-1, -1] = np.maximum.reduceat(g[:, 0], begin)
        return x

    def _run(self, xw: np.ndarray, mask: np.ndarray | None, d: str, keep: list | None) -> np.ndarray:
        """Hidden states of one direction; xw is (T, B, 3H). ``mask`` is None where every place holds a word."""
        U, H = self.p[f"U{d}"], HIDDEN
        steps = range(len(xw)) if d == "f" else range(len(xw) - 1, -1, -1)
        h = np.zeros((xw.shape[1], H), np.float32)
        out = np.empty((len(xw), xw.shape[1], H), np.float32)
        for t in steps:
            hu = h @ U
            zr = hu[:, : 2 * H] + xw[t, :, : 2 * H]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :H], zr[:, H:]
            n = r * hu[:, 2 * H :]
            n += xw[t, :, 2 * H :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if mask is not None:
                new = np.where(mask[t], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * H :]))
            out[t] = h = new
        return out

    def logits(self, x: np.ndarray, windows: np.ndarray, tape: dict | None = None) -> np.ndarray:
        idx = np.ascontiguousarray(windows.T)
        inside = idx < len(x) - 1
        mask = None if tape is None and inside.all() else inside[:, :, None]
        h = np.empty((*idx.shape, 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            keep = [] if tape is not None else None
            xw = np.take(x @ self.p[f"W{d}"] + self.p[f"b{d}"], idx, axis=0)
            h[:, :, k * HIDDEN : (k + 1) * HIDDEN] = self._run(xw, mask, d, keep)
            if tape is not None:
                tape[d] = keep
        u = np.tanh((h.reshape(-1, 2 * HIDDEN) @ self.p["A"]).reshape(*idx.shape, HIDDEN))
        a = u @ self.p["v"]
        if mask is not None:
            a = np.where(inside, a, -1e9)
        a = np.exp(a - a.max(0))
        if mask is not None:
            a = a * inside
        a = (a / np.maximum(a.sum(0), 1e-9)).astype(np.float32)
        pooled = np.einsum("tb,tbk->bk", a, h)
        if tape is not None:
            tape |= {"h": h, "u": u, "a": a, "pooled": pooled, "mask": mask, "idx": idx}
        return pooled @ self.p["o"] + self.p["c"][0]

    def all_logits(self, x: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Logits of many windows, the full ones apart from those that need a mask."""
        full = windows[:, -1] < len(x) - 1
        out = np.empty(len(windows), np.float32)
        for part in (np.flatnonzero(full), np.flatnonzero(~full)):
            for k in range(0, len(part), BLOCK):
                out[part[k : k + BLOCK]] = self.logits(x, windows[part[k : k + BLOCK]])
        return out

    def gradient(self, x: np.ndarray, tape: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the input vectors."""
        p, H = self.p, HIDDEN
        h, u, a, mask, idx = (tape[k] for k in ("h", "u", "a", "mask", "idx"))
        g = {"o": tape["pooled"].T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["o"]
        dh = a[:, :, None] * dpool
        da = (h * dpool).sum(2)
        ds = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tb,tbk->k", ds, u)
        du = ds[:, :, None] * p["v"] * (1 - u * u)
        g["A"] = np.einsum("tbi,tbk->ik", h, du)
        dh = dh + du @ p["A"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            U = p[f"U{d}"]
            gu, dhh = np.zeros_like(U), dh[:, :, k * H : (k + 1) * H]
            dxw = np.zeros((len(idx), idx.shape[1], 3 * H), np.float32)
            carry = np.zeros((idx.shape[1], H), np.float32)
            for t, before, z, r, n, hn in reversed(tape[d]):
                total = dhh[t] + carry
                live = total * mask[t]
                dz = live * (before - n) * z * (1 - z)
                dn = live * (1 - z) * (1 - n * n)
                dr = dn * hn * r * (1 - r)
                dxw[t] = np.concatenate((dz, dr, dn), 1)
                dhu = np.concatenate((dz, dr, dn * r), 1)
                gu += before.T @ dhu
                carry = np.where(mask[t], live * z, total) + dhu @ U.T
            g[f"U{d}"] = gu
            g[f"b{d}"] = dxw.sum((0, 1))
            flat = np.zeros((len(x), 3 * H), np.float32)
            np.add.at(flat, idx.reshape(-1), dxw.reshape(-1, 3 * H))
            g[f"W{d}"] = x.T @ flat
            dx += flat @ p[f"W{d}"].T
        return g, dx

    def score(self, words: Words) -> np.ndarray:
        """Each row's strongest window, as a probability."""
        x = self.inputs(words)
        windows, row = words.windows()
        logit = self.all_logits(x, windows)
        best = np.full(words.rows, -np.inf)
        np.maximum.at(best, row, logit)
        return np.round(_sigmoid(best.astype(np.float64)), 6)


def _log_odds(seen: np.ndarray, label: np.ndarray, row: np.ndarray, buckets: int) -> np.ndarray:
    """Smoothed log-odds of a bucket's presence in label-1 against label-0 texts; 0 below three texts."""
    pair = np.unique(row * buckets + seen)
    text, bucket = pair // buckets, pair % buckets
    one = np.bincount(bucket[label[text] == 1], minlength=buckets)
    none = np.bincount(bucket[label[text] == 0], minlength=buckets)
    n1, n0 = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    odds = np.log((one + 0.5) / (n1 + 1)) - np.log((none + 0.5) / (n0 + 1))
    odds = np.clip(odds, -5, 5) * np.minimum(1, (one + none) / 8)
    odds[one + none < 3] = 0
    return (odds / 2).astype(np.float32)


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Network:
    """Fit on labelled texts (every other one gives the statistics, the rest the gradient)."""
    net = Network(seed)
    label = np.array(labels, np.int64)
    rate = np.clip((label.sum() + 0.5) / (len(label) + 1), 1e-3, 1 - 1e-3)
    net.p["c"][0] = np.log(rate / (1 - rate))
    if len(set(labels)) < 2:
        return net
    half = np.arange(len(label)) % 2 == 0
    first = Words(pa.array([t for t, k in zip(texts, half, strict=True) if k], pa.string()))
    row = np.repeat(np.arange(first.rows), first.counts)
    net.word[:, 0] = _log_odds(first.word[first.at], label[half], row, WORD_BUCKETS)
    # a text's distinct words have all its grams
    pair = np.unique(row * max(1, first.n) + first.at)
    row, which = pair // max(1, first.n), pair % max(1, first.n)
    size = first.grams[which]
    net.char[:, 0] = _log_odds(first.gram[C.ragged(first.gram_begin[which], size)], label[half], np.repeat(row, size), CHAR_BUCKETS)
    del first, pair, which, row, size
    words = Words(pa.array([t for t, k in zip(texts, half, strict=True) if not k], pa.string()))
    y = label[~half]
    windows, row = words.windows()
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    tables = {"word": np.full(WORD_BUCKETS, 1e-6, np.float32), "char": np.full(CHAR_BUCKETS, 1e-6, np.float32)}
    rng, step = np.random.default_rng(seed), 0
    for _ in range(EPOCHS):
        x = net.inputs(words)
        logit = net.all_logits(x, windows)
        # each text's strongest window carries its label
        order = np.lexsort((logit, row))
        last = np.append(np.flatnonzero(np.diff(row[order])), len(order) - 1)
        strongest = order[last]
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            step += 1
            used, inverse = np.unique(windows[strongest[part]], return_inverse=True)
            used = used[used < words.n]
            x = net.inputs(words, used)
            tape: dict = {}
            out = net.logits(x, inverse.reshape(-1, WINDOW), tape)
            error = ((_sigmoid(out) - y[part]) / len(part)).astype(np.float32)
            g, dx = net.gradient(x, tape, error)
            for k, v in g.items():
                m, s = state[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            _sparse(net.word, tables["word"], words.word[used], dx[:-1, :DIM])
            size = words.grams[used]
            share = np.repeat(dx[:-1, DIM:-1] / size[:, None], size, axis=0)
            _sparse(net.char, tables["char"], words.gram[C.ragged(words.gram_begin[used], size)], share)
    return net


def _sparse(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """Adagrad on some rows; the first column (log-odds) stays."""
    distinct, back = np.unique(rows, return_inverse=True)
    g = np.zeros((len(distinct), table.shape[1]), np.float32)
    np.add.at(g, back, gradient)
    g[:, 0] = 0
    seen[distinct] += (g * g).sum(1)
    table[distinct] -= 0.05 * g / np.sqrt(seen[distinct])[:, None]


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> tuple[list, list]:
    """The bounded training sample: labelled texts out of the held-out fold, by a hash of their id."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    if not picked:
        return [], []
    # at most max_docs ids travel to the scan; texts are not shuffled
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int")
    rows = C.own_columns(docs, "doc_id", "text").filter(F.col("text").isNotNull() & (F.char_length("text") <= max_chars))
    # of rows that share an id the least text counts, so max_docs bounds what comes to the driver
    found = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    place = {r.doc_id: k for k, r in enumerate(picked)}
    found.sort(key=lambda r: (place[r.doc_id], r.text))
    return [r.text for r in found], [r.toxic for r in found]


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id and score of every row; with ``carry`` all columns of ``docs`` in a struct ``row`` instead of the id."""
    rows = docs.select((F.struct("*") if carry else F.col(f"`{id_col}`")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("row" if carry else id_col, rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def work(table: pa.Table) -> pa.Table:
        return pa.table([table["id"], pa.array(net.score(Words(table["text"])))], names=schema.names)

    return C.map_chunks(rows, lambda: work, schema, target=4 << 20)


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Network:
    return train(*sample(docs, labels, **bounds))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold. Columns as in ``docs``."""
    kept = score(docs, net, carry=True).filter(F.col("score") < threshold)
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
