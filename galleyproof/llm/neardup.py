"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Documents become sets of hashed five-word shingles; equal sets are one node. A node's signature is a path in each of TREES prefix tries
(MAX_DEPTH min-hashes, PART bytes each). A trie is its paths in sorted order, dealt over the tasks by range: nodes that share a prefix
stand side by side, and the common prefix of neighbours tells how deep. The matched prefix is shortened from MAX_DEPTH until a pair of
just the threshold meets in some tree with probability RECALL or more; so the depth follows from threshold and target, and holds for
every pair, whatever the data. A run of neighbours that match ties its nodes to its first one (a run that goes on in the next task is
tied across the border); tied nodes are a candidate group, and all pairs of a group are verified on the whole sets.

Verification works on blocks: a group of n nodes is cut into blocks of at most BLOCK, each pair of blocks is a task of its own that
counts links without giving the pairs out, and only a spanning forest of links leaves it. So a large group is spread over tasks and
no partner or candidate is dropped; comparisons within one group of *different* near copies remain quadratic, copies cost nothing.

Defined results: texts of one to four words have one shingle of all words; a null or word-less text is a class of its own without
links; repeated rows and equal texts share a class and count each other as links; a null id never names a class that has other ids;
extra columns are passed over. Shingles and whole sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.llm import common as C
from galleyproof.llm import graph

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, RECALL = 20, 6, 0.999
#: Bytes of a path's step.
PART = 2
#: Most nodes of a block that is verified at a time.
BLOCK = 64

_SEEDS = np.random.default_rng(12345).integers(1, 1 << 63, TREES * MAX_DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def reached(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """Probability that two sets of Jaccard ``threshold`` share a prefix of ``depth`` in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def matched_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix that reaches the target recall."""
    depth = MAX_DEPTH
    while depth > 1 and reached(depth, threshold) < recall:
        depth -= 1
    return depth


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and how many each text has."""
    data, offsets = C.flat_text(texts)
    words, row = C.split_words(data.tobytes().translate(C.WORD_TABLE), offsets)
    n = len(offsets) - 1
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    coded = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = np.concatenate((hashes[np.asarray(coded.indices)], np.zeros(SHINGLE, np.uint64)))
    size = np.bincount(row, minlength=n)
    per = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    where = C.ragged(np.cumsum(size) - size, per)
    of = np.repeat(np.arange(n), per)
    left = np.cumsum(size)[of] - where
    total = np.zeros(len(where), np.uint64)
    for k in range(SHINGLE):
        part = np.where(left > k, h[where + k] + np.uint64(1), np.uint64(0))
        total = (total ^ part) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    order = np.lexsort((total, of))
    total, of = total[order], of[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
    return total[new], np.bincount(of[new], minlength=n)


SIGNED = T.StructType([T.StructField("id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("paths", T.BinaryType())])


def _sets_to_nodes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each whole set; 0 for the empty one."""
    raw, stop = values.tobytes(), np.cumsum(counts) * 8
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[b - 8 * c : b]) if c else 0 for b, c in zip(stop.tolist(), counts.tolist(), strict=True)), np.uint64, len(counts)).astype(np.int64)


def _paths(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per non-empty set, its path in every tree: TREES x MAX_DEPTH steps of PART bytes."""
    use = counts > 0
    begin = (np.cumsum(counts) - counts)[use]
    mixed = values ^ (values >> np.uint64(31))
    steps = np.zeros((len(begin), TREES * MAX_DEPTH), ">u2")
    for k in range(TREES * MAX_DEPTH):
        h = mixed * _SEEDS[k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        steps[:, k] = np.minimum.reduceat(h, begin) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
    return steps.view(np.uint8).reshape(len(begin), -1)


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, node (0: no words), paths (none without words)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def work(table: pa.Table) -> pa.Table:
        values, counts = shingle_sets(table["text"])
        nodes = _sets_to_nodes(values, counts)
        paths: list[bytes | None] = [None] * len(counts)
        if len(values):
            for k, path in zip(np.flatnonzero(counts).tolist(), _paths(values, counts), strict=True):
                paths[k] = path.tobytes()
        return pa.table([table["id"], pa.array(nodes), pa.array(paths, pa.binary())], names=SIGNED.names)

    return C.map_chunks(rows, lambda: work, SIGNED, target=4 << 20)


TIES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("first", T.BinaryType()), T.StructField("last", T.BinaryType())])


def ties(nodes: DataFrame, depth: int) -> DataFrame:
    """(a, b) of nodes that share a prefix of ``depth`` in some tree, each tied to the first of its run of the sorted paths."""
    size = MAX_DEPTH * PART
    one = nodes.select("node", "paths", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trie = one.select("tree", F.expr(f"substring(paths, 1 + tree * {size}, {size})").alias("path"), "node")
    # the node too deals out a path that very many nodes have
    trie = trie.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")

    def runs(batches):
        task, first, last, root = TaskContext.get().partitionId(), None, None, 0
        opened = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.empty((n, 1 + depth * PART), np.uint8)
            key[:, 0] = np.asarray(batch.column("tree"))
            key[:, 1:] = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8).reshape(n, size)[:, : depth * PART]
            node = np.asarray(batch.column("node"), dtype=np.int64)
            same = np.zeros(n, bool)
            same[1:] = (key[1:] == key[:-1]).all(1)
            same[0] = last is not None and key[0].tobytes() == last
            if first is None:
                first, opened = key[0].tobytes(), int(node[0])
            begin = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
            roots = np.where(begin >= 0, node[np.maximum(begin, 0)], root)
            last, root = key[-1].tobytes(), int(roots[-1])
            tied = np.flatnonzero(same)
            none = pa.nulls(len(tied))
            yield from pa.table([pa.array(node[tied]), pa.array(roots[tied]), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())], names=TIES.names).to_batches()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([opened]), pa.array([root]), pa.array([task], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=TIES.names)

    found = C.settle(trie.mapInArrow(runs, TIES))
    # one row a task: a run may go on over its border
    border = Window.orderBy("task")
    across = found.filter("task is not null").select("first", F.col("a").alias("b"), F.lag("last").over(border).alias("before"), F.lag("b").over(border).alias("a"))
    return found.filter("task is null").select("a", "b").unionAll(across.filter("first = before").select("a", "b"))


SETS = T.StructType([*(T.StructField(n, T.LongType()) for n in ("node", "comp", "copies", "block", "other", "blocks")), T.StructField("shingles", T.BinaryType())])
LINKS = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType()), T.StructField("links", T.LongType())])


def _verify(table: pa.Table, threshold: float) -> pa.Table:
    """Links between the nodes of one block, or across two: per node their number (copies counted), and its root in the block's forest."""
    node, copies, block = (np.asarray(table[c], dtype=np.int64) for c in ("node", "copies", "block"))
    sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.cumsum(size) - size
    n = len(sets)
    across = len(np.unique(block)) > 1
    own_only = not across and table["block"][0].as_py() != table["other"][0].as_py()
    links, parent = np.zeros(n, np.int64), np.arange(n)
    if own_only:
        return pa.table([pa.array(node[:0]), pa.array(node[:0]), pa.array(links[:0])], names=LINKS.names)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    mark = np.zeros(int(flat.max()) + 1, bool)
    for i in range(n):
        mine = flat[begin[i] : begin[i] + size[i]]
        mark[mine] = True
        both = np.add.reduceat(mark[flat], begin)
        mark[mine] = False
        close = both >= threshold * (size + size[i] - both) - 1e-9
        close[i] = False
        if across:
            close &= block != block[i]
        links[i] = copies[close].sum()
        for j in np.flatnonzero(close[:i]).tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[a] = b
    root = node[[find(i) for i in range(n)]]
    use = links > 0
    return pa.table([pa.array(node[use]), pa.array(root[use]), pa.array(links[use])], names=LINKS.names)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(signed, found): each row's id and node, and for each node copies, n_links, class_node, class_id (the least id of the class)."""
    signed = C.settle(sign(docs, id_col, text_col))
    nodes = C.settle(signed.filter("node != 0").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("paths").alias("paths")))
    comps = graph.components(ties(nodes, matched_depth(threshold, recall)))
    sizes = comps.groupBy("comp").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("long")
    groups = comps.join(sizes, "comp").select("node", "comp", blocks.alias("blocks"))
    # one text for each node of a group: that of its least id
    wanted = C.settle(groups.join(nodes.select("node", "id", "copies"), "node"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    one = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"])).select(texts["text"], "node", "comp", "copies", "blocks")

    def load(table: pa.Table) -> pa.Table:
        values, counts = shingle_sets(table["text"])
        use = np.flatnonzero(_sets_to_nodes(values, counts) == np.asarray(table["node"], dtype=np.int64))
        raw, stop = values.tobytes(), np.cumsum(counts) * 8
        sets = [raw[stop[k] - 8 * counts[k] : stop[k]] for k in use.tolist()]
        part = table.take(use)
        zero = pa.array(np.zeros(len(use), np.int64))
        return pa.table([part["node"], part["comp"], part["copies"], zero, zero, part["blocks"], pa.array(sets, pa.binary())], names=SETS.names)

    sets = C.map_chunks(one, lambda: load, SETS)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = sets.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    # an id that stands for several rows of one node gives the node more than once
    pairs = pairs.dropDuplicates(["node", "other"]) if _repeats(signed) else pairs
    verified = C.settle(pairs.groupBy("comp", "low", "high").applyInArrow(lambda t: _verify(t, threshold), LINKS))
    classed = graph.components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.select("node", "id", "copies").join(classed, "node", "left").join(links, "node", "left")
    found = found.select("node", "id", "copies", F.coalesce("comp", "node").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # a class is named by its least id, and stands by the node that has it
    named = found.groupBy("comp").agg(F.min("id").alias("class_id"), F.min_by("node", F.struct(F.col("id").isNull(), "id", "node")).alias("class_node"))
    return signed.select("id", "node"), C.settle(found.join(named, "comp").select("node", "id", "n_links", "class_id", "class_node"))


def _repeats(signed: DataFrame) -> bool:
    """Whether some id stands for more than one row."""
    return not signed.groupBy("id").count().filter("count > 1").isEmpty()


def join_classes(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, class_id, n_links (documents of Jaccard ``threshold`` or more, copies included) of every row."""
    signed, found = classes(docs, id_col, **options)
    rows = signed.join(found.select("node", "class_id", "n_links"), "node", "left")
    return rows.select(F.col("id").alias(id_col), F.when(F.col("node") == 0, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class (that of the least id), and every row without words. Columns as in ``docs``."""
    _, found = classes(docs, id_col, text_col, **options)
    keep = found.filter("node = class_node").select(F.col("node").alias("kept"), F.col("id").alias("kept_id"))
    packed = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("id", T.LongType()), T.StructField("node", T.LongType())])

    def work(table: pa.Table) -> pa.Table:
        return pa.table([table["row"], table["id"], pa.array(_sets_to_nodes(*shingle_sets(table["text"])))], names=schema.names)

    rows = C.map_chunks(packed, lambda: work, schema)
    silent = rows.filter("node = 0").select("row")
    first = rows.join(keep, (F.col("node") == F.col("kept")) & F.col("id").eqNullSafe(F.col("kept_id"))).dropDuplicates(["node"]).select("row")
    return first.unionAll(silent).select("row.*")


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
