"""Token counts by dynamic programming over a trie.

Distinct pre-tokens, cut where no piece of the vocabulary reaches across, go into a trie; the best unigram score of each prefix is
computed once, when its node is made, from the scores of its ancestors, so words that begin alike share that work. A word's token count
is kept at its terminal node. Texts then add up the counts of their parts.

The score of a segmentation is the sum of the vocabulary's piece scores; of equally good ones the one of fewest tokens counts. A
character that no piece spells costs the lowest score less 10, and counts a token per UTF-8 byte.

The trie lives as long as a worker stays with this operator. It starts anew beyond MAX_NODES, and nodes deeper than DEEP characters are
not stored: from there on a word goes through a window of its last states. Both bound memory and leave every count as it is.

Defined results: null and empty texts have 0 tokens; repeated rows each count; extra columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from galleyproof.llm import common as C
from galleyproof.llm import pieces as P

MAX_NODES, DEEP = 400_000, 64
#: Scores are scaled to integers, and a token costs one unit: it settles ties.
SCALE = 1 << 24

class ScoreTrie:
    def __init__(self, vocabulary: P.Vocabulary):
        self.vocabulary = vocabulary
        self.vocab = {p.replace(P.SPACE, P.GAP): round(float(vocabulary.scores[i]) * 16) * SCALE - 1 for p, i in vocabulary.pieces.items()}
        self.unknown = min(self.vocab.values()) - 160 * SCALE
        self.longest = vocabulary.longest
        self._reset()

    def _reset(self) -> None:
        self.children: list[dict[str, int] | None] = [None]
        self.best, self.tokens = [0], [0]

    def count(self, word: str) -> int:
        """Insert ``word`` and give its token count; only nodes that are new are scored."""
        children, best, tokens, vocab, longest = self.children, self.best, self.tokens, self.vocab, self.longest
        path = [0]
        node = 0
        for end, ch in enumerate(word[:DEEP], 1):
            below = children[node]
            if below is None:
                below = children[node] = {}
            child = below.get(ch)
            if child is None:
                child = below[ch] = len(best)
                size = len(ch.encode())
                top, count = best[node] + self.unknown - size, tokens[node] + size
                for start in range(max(0, end - longest), end):
                    score = vocab.get(word[start:end])
                    if score is not None and best[path[start]] + score > top:
                        top, count = best[path[start]] + score, tokens[path[start]] + 1
                children.append(None)
                best.append(top)
                tokens.append(count)
            node = child
            path.append(node)
        if len(word) <= DEEP:
            return tokens[node]
        tops, counts = [best[k] for k in path], [tokens[k] for k in path]
        for end in range(DEEP + 1, len(word) + 1):
            size = len(word[end - 1].encode())
            top, count = tops[-1] + self.unknown - size, counts[-1] + size
            for back in range(1, min(longest, end) + 1):
                score = vocab.get(word[end - back : end])
                if score is not None and tops[-back] + score > top:
                    top, count = tops[-back] + score, counts[-back] + 1
            tops.append(top)
            counts.append(count)
            if len(tops) > 2 * longest + DEEP:
                del tops[:-longest], counts[:-longest]
        return counts[-1]

    def token_counts(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        for k, word in enumerate(words):
            if len(self.best) > MAX_NODES:
                self._reset()
            out[k] = self.count(word)
        return out


def trie(path: str) -> ScoreTrie:
    return C.kept(("tokencounts", path), lambda: ScoreTrie(P.vocabulary(path)))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pretokens, n_tokens of every row. One narrow map; no shuffle."""
    rows = C.own_columns(docs, id_col, text_col).toDF("id", "text")
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    @C.keeping
    def make():
        words = trie(model)

        def work(table: pa.Table) -> pa.Table:
            coded, row, head = P.stretches(words.vocabulary, table["text"])
            counts = words.token_counts(coded.dictionary.to_pylist())
            n = table.num_rows
            total = np.bincount(row, weights=counts[np.asarray(coded.indices, dtype=np.int64)], minlength=n).astype(np.int64)
            return pa.table([table["id"], pa.array(np.bincount(row[head], minlength=n)), pa.array(total)], names=schema.names)

        return work

    return C.map_chunks(rows, make, schema)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.default_model())
