"""N-gram Jaccard join by MinHash banding.

1. Each document becomes the set of its five-word shingles; documents with
   equal sets are one node from here on. A node has a MinHash signature in
   bands; the number of bands and rows follows from the threshold and the
   wanted recall.
2. A shuffle on band hashes finds the buckets with two nodes or more. A bucket
   gives an edge from each node to its smallest, never all pairs; the
   components of these edges are candidate groups.
3. A group's nodes, with their full shingle sets, are laid out by set size in
   blocks of about ``BLOCK`` shingles; tasks compare pairs of blocks and leave out those whose
   sizes rule the threshold out. Shared shingles of a pair of blocks are counted
   by a matrix product, so every pair of a candidate group is verified exactly
   and only counts and a spanning forest leave the task. In a group of more than
   ``GROUP`` nodes the pairs of each bucket are compared instead, and a pair
   counts in the first bucket that it shares.
4. The components of the verified links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import shingles as sh
from plumbline.llm.common import bound_batches, fresh, materialize, table
from plumbline.llm.components import components

THRESHOLD = 0.8
RECALL = 0.9999
#: Shingles in a block; a set counts for at least LEAST of them, which bounds the sets in a block.
BLOCK, LEAST = 1 << 17, 1 << 10
#: Nodes of a candidate group of which all pairs are compared; in a larger one, which unlike texts may have chained, the pairs of each bucket.
GROUP = 20_000
#: Hash functions are dealt in these numbers a band.
ROWS = range(1, 11)


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding that reaches the recall at the threshold within the hashes."""
    best = None
    for rows in ROWS:
        for bands in range(1, most_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(1)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        self.weights = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self.band = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A hash for each band, different between bands."""
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(low), 4096):
            np.minimum(least, (low[i : i + 4096, None] * self.a + self.b).min(axis=0), out=least)
        return sh.mix((least.reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, minhash: MinHash) -> DataFrame:
    """doc_id, node (128-bit hash of the shingle set, null without words), size and band keys."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for words in sh.word_hashes([t or "" for t in batch.column(1).to_pylist()]):
                s = sh.shingle_set(words)
                nodes.append(sh.fingerprint(s) if len(s) else None)
                sizes.append(len(s))
                keys.append(minhash.keys(s) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "size", "keys"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(sign, f"doc_id {kind}, node binary, size long, keys array<long>")


def _bucket_edges(nodes: DataFrame) -> DataFrame:
    """Edges from the nodes of each bucket to its smallest node."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("root"), F.max("node").alias("_last")).where("root <> _last").select("key", "root")
    return keyed.join(buckets, "key").where("node <> root").select("node", "root").distinct()


def _by_bucket(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members once for each bucket they share with another: root is the bucket's key, band its number, keys all of a node's keys."""
    keyed = members.join(nodes.select("node", "keys"), "node").select("node", "size", "copies", "keys", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keyed.join(shared, "key", "left_semi").select("node", F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("root"), "size", "copies", "band", "keys")


def _tiles(members: DataFrame, threshold: float) -> DataFrame:
    """Deal the members of each group, in order of set size, into blocks, and each block to the pairs of blocks it is in.

    members: node, root, size, copies, and others that stay. Ranks come from counts by size, so a
    large group is never sorted in one task. A block pair is left out if its
    largest small set is below the threshold times its smallest large set.
    """
    weight = F.greatest("size", F.lit(LEAST))
    by_size = members.groupBy("root", "size").agg((F.count(F.lit(1)) * weight).alias("n"))
    running = Window.partitionBy("root").orderBy("size")
    by_size = by_size.withColumns({"before": F.sum("n").over(running) - F.col("n")}).drop("n")
    # Within one size any order will do; a hash spreads it over salted ranks without a sort of the whole group.
    within = Window.partitionBy("root", "size", "salt").orderBy("node")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    per_salt = salted.groupBy("root", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    per_salt = per_salt.withColumn("ahead", F.sum("n").over(Window.partitionBy("root", "size").orderBy("salt")) - F.col("n")).drop("n")
    ranked = (
        salted.withColumn("rank", F.row_number().over(within) - 1)
        .join(per_salt, ["root", "size", "salt"])
        .join(by_size, ["root", "size"])
        .select(*members.columns, F.floor(((F.col("rank") + F.col("ahead")) * weight + F.col("before")) / BLOCK).cast("int").alias("block"))
    )
    blocks = ranked.groupBy("root", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    a, b = blocks.toDF("root", "block", "low", "high"), blocks.toDF("root_b", "block_b", "low_b", "high_b")
    pairs = a.join(b, (F.col("root") == F.col("root_b")) & (F.col("block") <= F.col("block_b"))).where(F.col("high") >= threshold * F.col("low_b"))
    pairs = pairs.select("root", F.col("block").alias("i"), F.col("block_b").alias("j"))
    of = pairs.select("root", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")
    return ranked.join(of, ["root", "block"])


def compare_blocks(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: Jaccard similarity of the sets of a and b is at least the threshold."""
    size_a, size_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    values = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b), dtype=np.int32), np.concatenate([size_a, size_b]))
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    # Shingles that only one side has can't be shared.
    sides = np.zeros((2, column[-1] + 1), bool)
    sides[(owner >= len(a)).astype(int), column] = True
    both = sides.all(axis=0)
    renumber = np.cumsum(both) - 1
    keep = both[column]
    owner, column = owner[keep], renumber[column[keep]]
    shared = np.zeros((len(a), len(b)), np.float32)
    width = 8192
    starts = np.searchsorted(column, np.arange(0, int(both.sum()) + width, width))
    for k in range(len(starts) - 1):
        o, c = owner[starts[k] : starts[k + 1]], column[starts[k] : starts[k + 1]] - k * width
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[o, c] = 1
        shared += m[: len(a)] @ m[len(a) :].T
    # Sizes and counts are exact in these types; the product form needs no division.
    return shared.astype(np.float64) >= threshold * (size_a[:, None] + size_b[None, :] - shared.astype(np.float64)) - 1e-9


def _verify(threshold: float):
    def verify(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        group = group.sort_values("node")
        side = [group[group["block"] == x] for x in ((i,) if i == j else (i, j))]
        sets = [[np.frombuffer(x, np.uint64) for x in s["shingles"]] for s in side]
        nodes = [n for s in side for n in s["node"]]
        copies = np.concatenate([s["copies"].to_numpy() for s in side])
        links = np.zeros((len(nodes), len(nodes)), bool)
        if all(len(s) for s in side):
            if i == j:
                links[:] = compare_blocks(sets[0], sets[0], threshold)
                np.fill_diagonal(links, False)
            else:
                n = len(sets[0])
                links[:n, n:] = compare_blocks(sets[0], sets[1], threshold)
                links[n:, :n] = links[:n, n:].T
        if (band := int(group["band"].iloc[0])) >= 0:  # a pair meets in each bucket it shares; it counts in the first
            keys = np.array([list(k) for s in side for k in s["keys"]], np.int64).reshape(len(nodes), -1)
            a, b = np.nonzero(links)
            links[a, b] = (keys[a] == keys[b]).argmax(axis=1) == band
        root = np.arange(len(nodes))
        for x in range(len(nodes)):
            if root[x] == x:  # flood from the first node not reached yet
                seen = np.zeros(len(nodes), bool)
                front = seen.copy()
                front[x] = True
                while front.any():
                    seen |= front
                    front = links[front].any(axis=0) & ~seen
                root[seen] = x
        return pd.DataFrame({"node": nodes, "root": [nodes[r] for r in root], "links": links.sum(axis=1).astype(np.int64), "linked": (links * copies[None, :]).sum(axis=1).astype(np.int64)})

    return verify


def _members(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """Adds the shingle sets to ``wanted`` (node, doc_id of one of its documents, and more)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sh.shingle_set(w).tobytes() for w in sh.word_hashes([t or "" for t in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array([sh.fingerprint(np.frombuffer(s, np.uint64)) for s in found], pa.binary()), pa.array(found, pa.binary())], names=["node", "shingles"])

    return docs.select(F.col(text)).mapInArrow(sets, "node binary, shingles binary")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_text_links.

    class_id is the smallest key of the documents joined by links, n_links the
    number of other documents with a similarity of ``threshold`` or more
    (copies count), n_text_links that of different shingle sets among them.
    Null and empty texts and texts without words link to nothing and are
    classes of their own; equal rows are copies of one another; an empty table
    gives an empty result. Rows with a null key keep their links; their class
    has the smallest key that is there, if any.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    signed = materialize(signatures(docs, doc_id, text, MinHash(bands, rows)))
    nodes = materialize(
        signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    )
    grouped = components(_bucket_edges(nodes))
    roots = grouped.select(F.col("root").alias("node"), "root").distinct()
    members = grouped.union(roots).join(nodes.select("node", "doc", "copies", "size"), "node")
    members = materialize(members, spark)

    # The texts of the members come by the key of one document of each node, where keys are there, and are cut to shingles before the shuffle.
    sets = _shingles_of(docs, doc_id, text, members)
    plain = members.select("node", "root", "size", "copies")
    large = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("root")
    none = F.array().cast("array<bigint>")
    if large.isEmpty():
        tiles = _tiles(plain.withColumns({"band": F.lit(-1), "keys": none}), threshold)
    else:
        few = plain.join(large, "root", "left_anti").select(*plain.columns).withColumns({"band": F.lit(-1), "keys": none})
        tiles = _tiles(few, threshold).unionByName(_tiles(_by_bucket(plain.join(large, "root", "left_semi"), nodes), threshold))
    bound_batches(spark, 200)
    verified = materialize(
        tiles.join(sets, "node").groupBy(F.col("root").alias("_r"), F.col("band").alias("_b"), F.col("i").alias("_i"), F.col("j").alias("_j")).applyInPandas(_verify(threshold), "node binary, root binary, links long, linked long"),
        spark,
    )
    links = verified.groupBy("node").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    classes = components(verified.select("node", "root").where("node <> root"))
    # All that is known of a node, written, so that the joins with hot classes and copies are of two plain shuffles, which the adaptive join splits.
    known = nodes.select("node", "doc", "copies").join(links, "node", "left").join(classes, "node", "left")
    known = materialize(known.select("node", "doc", "copies", "links", "linked", F.coalesce("root", "node").alias("root")), spark)
    least = materialize(known.groupBy("root").agg(F.min("doc").alias("class_id")), spark)
    known = materialize(known.join(least, "root").select("node", "copies", "links", "linked", "class_id"), spark)
    return signed.select("doc_id", "node").join(known, "node", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_text_links"),
    )


def _shingles_of(docs: DataFrame, doc_id: str, text: str, members: DataFrame) -> DataFrame:
    """node and its shingle set (packed), once per node."""
    keyed = members.where("doc is not null").select(F.col("doc").alias(doc_id)).distinct()
    texts = docs.select(F.col(doc_id), F.col(text)).join(keyed, doc_id, "left_semi")
    unkeyed = docs.where(F.col(doc_id).isNull()).select(F.col(doc_id), F.col(text))
    found = _members(texts.union(unkeyed), text, members)
    return found.join(members.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Of each class the row with the smallest key, with all its columns; classes of one row stay as they are.

    Rows that share a key are one document: the smallest of them in the order
    of all columns stays. Rows with a null key can't be told apart and stay.
    """
    one_id, one_class, row = (fresh(x, docs) for x in ("_id", "_class", "_row"))
    classes = materialize(near_duplicate_classes(docs, doc_id, text, threshold).select(F.col("doc_id").alias(one_id), F.col("class_id").alias(one_class)), docs.sparkSession)
    extra = classes.where(F.col(one_id) != F.col(one_class)).select(one_id).distinct()
    out = docs.join(extra, F.col(doc_id) == F.col(one_id), "left_anti")
    shared = classes.where(F.col(one_id).isNotNull()).groupBy(one_id).agg(F.count(F.lit(1)).alias(one_class)).where(F.col(one_class) > 1).select(one_id)
    if shared.isEmpty():
        return out
    one = out.join(shared, F.col(doc_id) == F.col(one_id), "left_semi").groupBy(F.col(doc_id).alias(one_id)).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return out.join(shared, F.col(doc_id) == F.col(one_id), "left_anti").union(one)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
