"""Sets of numbered nodes in blocks: common neighbours of pairs without a row for each of them.

Nodes get numbers in name order, so that a node with its neighbours is one row
of integers. Blocks hold about ``BLOCK`` neighbours; a task takes the rows of
two blocks, and only of the nodes that it needs, and counts in memory. What is
shuffled grows with the rows times the blocks that they meet, not with the
number of common neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.lineage import materialize, release, ship_package
from plumbline.plans.ordering import estimated_bytes, running_sum

#: Neighbours in a block; a node with more has its own.
BLOCK = 4_000_000
#: Pairs in an Arrow batch of results, and neighbours looked at in one step.
OUT, STEP = 200_000, 4_000_000
#: Up to this size of their files the numbers of nodes are broadcast.
FEW = 2 << 20
PAIRS = "graph_id string, a string, b string, shared long, similarity double, forth boolean, back boolean"


def numbered(nodes: DataFrame) -> DataFrame:
    """graph_id, id, n: numbers from 0 without gaps, in the order of graph and name."""
    parts = materialize(nodes.select("graph_id", "id").repartitionByRange("graph_id", "id").sortWithinPartitions("graph_id", "id").withColumn("m", F.monotonically_increasing_id()))
    sizes = parts.groupBy(F.shiftright("m", 33).alias("part")).agg(F.count(F.lit(1)).alias("k"))
    starts = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("start"))  # a row for each partition
    place = (F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int")
    return materialize(parts.join(F.broadcast(starts), F.shiftright("m", 33) == F.col("part")).select("graph_id", "id", place.alias("n")))


def coded(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """s, t: the numbers of the ends of the edges."""
    if estimated_bytes(numbers) <= FEW:
        numbers = F.broadcast(numbers)
    out = edges.join(numbers.toDF("graph_id", "src", "s"), ["graph_id", "src"]).select("graph_id", "s", "tgt")
    return out.join(numbers.toDF("graph_id", "tgt", "t"), ["graph_id", "tgt"]).select("s", "t")


def rows_of(entries: DataFrame, numbers: DataFrame) -> DataFrame:
    """graph_id, id, n, ws: each node with its sorted neighbours. entries: distinct n, w."""
    sets = entries.groupBy("n").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return materialize(sets.join(numbers, "n").select("graph_id", "id", "n", "ws"))


def undirected(pairs: DataFrame) -> DataFrame:
    """n, w both ways of distinct pairs x, y; a loop once."""
    return pairs.select("x", "y").union(pairs.where("x <> y").select("y", "x")).toDF("n", "w")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """n, d, block: blocks are runs of numbers."""
    sizes = materialize(rows.select("n", F.size("ws").cast("long").alias("d")))
    return materialize(running_sum(sizes, [], "n", "d", "upto").select("n", "d", F.floor((F.col("upto") - 1) / block).cast("int").alias("block")))


def _tasks(rows: DataFrame, count: Callable) -> DataFrame:
    """Rows bi, bj, graph_id, id, n, ws and more, by pairs of blocks: ``count`` gets a pair's rows as an Arrow table and yields batches."""
    ship_package(rows.sparkSession)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = (batch["bi"].to_numpy().astype(np.int64) << 32) | batch["bj"].to_numpy()
            edges = [0, *(np.nonzero(np.diff(code))[0] + 1), len(code)]
            for i, j in zip(edges, edges[1:], strict=False):
                if code[i] != key and waiting:
                    yield from count(pa.Table.from_batches(waiting))
                    waiting = []
                key = code[i]
                waiting.append(batch.slice(i, j - i))
        if waiting:
            yield from count(pa.Table.from_batches(waiting))

    return rows.repartition("bi", "bj").sortWithinPartitions("bi", "bj", "n").mapInArrow(solve, PAIRS)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists of a column and where each list starts (one more at the end); null is empty."""
    parts = [(c.flatten().to_numpy(), np.asarray(c.value_lengths().fill_null(0))) for c in column.chunks]
    lengths = np.concatenate([p[1] for p in parts]).astype(np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(lengths)])


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all members of lists, one list after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _batches(t: pa.Table, a: list, b: list, shared: list, flags: list, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b, shared, flags = (np.concatenate(x) for x in (a, b, shared, flags))
    graph, names = t["graph_id"].combine_chunks(), t["id"].combine_chunks()
    for i in range(0, len(a), OUT):
        p, q, n, f = (x[i : i + OUT] for x in (a, b, shared, flags))
        yield pa.RecordBatch.from_arrays(
            [graph.take(pa.array(p)), names.take(pa.array(p)), names.take(pa.array(q)), pa.array(n.astype(np.int64)), pa.array(n / (size[p] + size[q] - n)), pa.array((f & 1) > 0), pa.array((f & 2) > 0)],
            names=["graph_id", "a", "b", "shared", "similarity", "forth", "back"],
        )


def _count_wanted(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Common members for the listed partners of each row (number times 4 and two flags): the smaller sets are looked up in the larger."""
    n = t["n"].to_numpy()
    ws, at = _flat(t["ws"])
    size = np.diff(at)
    used, ws = np.unique(ws, return_inverse=True)
    wanted, first = _flat(t["ys"])
    mark = np.zeros(len(used), np.int32)
    out: tuple[list, ...] = ([], [], [], [])
    held = 0
    for x in np.nonzero(np.diff(first))[0]:
        mine = wanted[first[x] : first[x + 1]]
        ys = np.searchsorted(n, mine >> 2)
        mark[ws[at[x] : at[x + 1]]] = 1
        i = 0
        while i < len(ys):
            # Some partners at a time, as a hub has many.
            some = ys[i : i + max(1, int(np.searchsorted(np.cumsum(size[ys[i : i + OUT]]), STEP)))]
            hits = np.add.reduceat(mark[ws[_gather(at[some], size[some])]], np.concatenate([[0], np.cumsum(size[some])[:-1]]))
            for column, values in zip(out, (np.full(len(some), x), some, hits, mine[i : i + len(some)] & 3), strict=True):
                column.append(values)
            i += len(some)
            held += len(some)
            if held >= OUT:
                yield from _batches(t, *out, size)
                out, held = ([], [], [], []), 0
        mark[ws[at[x] : at[x + 1]]] = 0
    if held:
        yield from _batches(t, *out, size)


def _count_all(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Common members of each row of the first block with the later rows of the second that have any."""
    block, bi, bj = t["block"].to_numpy(), t["bi"][0].as_py(), t["bj"][0].as_py()
    ws, at = _flat(t["ws"])
    size = np.diff(at)
    _, ws = np.unique(ws, return_inverse=True)
    second = np.nonzero(block == bj)[0]
    members = ws[_gather(at[second], size[second])]
    owner = np.repeat(np.arange(len(second), dtype=np.int32), size[second])[np.argsort(members, kind="stable")]
    many = np.bincount(members, minlength=int(ws.max()) + 1)
    start = np.cumsum(many) - many
    graph = np.unique(np.asarray(t["graph_id"].combine_chunks().dictionary_encode().indices), return_inverse=True)[1]
    out: tuple[list, ...] = ([], [], [], [])
    held = 0
    for x in np.nonzero(block == bi)[0]:
        mine = ws[at[x] : at[x + 1]]
        found = np.zeros(len(second), np.int64)
        i = 0
        while i < len(mine):
            some = mine[i : i + max(1, int(np.searchsorted(np.cumsum(many[mine[i:]]), STEP)))]
            found += np.bincount(owner[_gather(start[some], many[some])], minlength=len(second))
            i += len(some)
        hit = np.nonzero(found)[0]
        hit = hit[(second[hit] > x) & (graph[second[hit]] == graph[x])]
        for column, values in zip(out, (np.full(len(hit), x), second[hit], found[hit], np.zeros(len(hit), np.int64)), strict=True):
            column.append(values)
        held += len(hit)
        if held >= OUT:
            yield from _batches(t, *out, size)
            out, held = ([], [], [], []), 0
    if held:
        yield from _batches(t, *out, size)


def overlaps_of(pairs: DataFrame, rows: DataFrame, block: int | None = None) -> DataFrame:
    """``PAIRS`` of the pairs x, y, forth, back (x to y is wanted, y to x is), a and b their names; rows as of ``rows_of``."""
    of = _blocks(rows, block or BLOCK)
    ends = pairs.join(of.toDF("x", "dx", "bx"), "x").join(of.toDF("y", "dy", "by"), "y")
    turned = F.col("dx") < F.col("dy")
    either = lambda p, q: F.when(turned, F.col(p)).otherwise(F.col(q))
    code = either("x", "y").cast("long") * 4 + either("back", "forth").cast("int") + either("forth", "back").cast("int") * 2
    ends = ends.select(F.least("bx", "by").alias("bi"), F.greatest("bx", "by").alias("bj"), either("y", "x").alias("n"), either("x", "y").alias("w"), code.alias("code"))
    wanted = materialize(ends.groupBy("bi", "bj", "n").agg(F.collect_list("code").alias("ys")))
    needed = wanted.select("bi", "bj", "n").union(wanted.select("bi", "bj", F.explode(F.transform("ys", lambda v: F.shiftright(v, 2).cast("int"))))).distinct()
    release(rows.sparkSession)
    return _tasks(needed.join(rows, "n").join(wanted, ["bi", "bj", "n"], "left").select("bi", "bj", "graph_id", "id", "n", "ws", "ys"), _count_wanted)


def all_overlaps(rows: DataFrame, block: int | None = None) -> DataFrame:
    """``PAIRS`` of all rows of a graph with a common member, a before b."""
    of = _blocks(rows, block or BLOCK).select("n", "block")
    rows = rows.join(of, "n")
    has = rows.select("block", F.explode("ws").alias("w")).distinct().groupBy("w").agg(F.collect_list("block").alias("bs"))
    met = has.select(F.explode("bs").alias("bi"), "bs").distinct().select("bi", F.explode("bs").alias("bj")).where("bi <= bj").distinct()
    met = materialize(met)
    either = met.select("bi", "bj", F.col("bi").alias("block")).union(met.select("bi", "bj", F.col("bj"))).distinct()
    return _tasks(rows.join(either, "block").select("bi", "bj", "graph_id", "id", "n", "ws", "block"), _count_all)
