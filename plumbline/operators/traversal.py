"""Iterative graph operators: components, cycles, reachability, communities.

Graphs whose edges fit a task's memory (``SMALL`` edges, counted first) are
solved one per group by a linear algorithm. The edges of a larger graph are
first replaced by fewer with the same reach (``reduced``), a part in each task;
if it is larger still, it goes through joins, a round at a time, with the state
kept in the shared folder, until nothing changes. All give the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.operators import blocks as bl
from plumbline.operators.graph import Graph
from plumbline.plans.lineage import materialize, release, ship_package

SMALL = 500_000
#: Sources whose reach is counted in one pass over a graph, a bit each.
SOURCES = 2048
#: Edges that a task looks at together when it reduces them.
PART = 500_000


def split_by_size(edges: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """Edges of the graphs up to ``small`` edges, and those of larger ones (None if there are none)."""
    counts = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    large = counts.where(F.col("n") > small).select("graph_id")
    if large.isEmpty():
        return edges, None
    return edges.join(large, "graph_id", "left_anti"), edges.join(large, "graph_id", "left_semi")


def strong_labels(n: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The smallest member of the strong component of each node 0, 1, ...: Tarjan's pass without recursion."""
    order = np.argsort(s, kind="stable")
    at = np.searchsorted(s[order], np.arange(n + 1)).tolist()
    targets, rest = t[order].tolist(), at[:-1]
    label, index, low = [-1] * n, [0] * n, [0] * n
    open_, path, count = [], [], 0
    for start in range(n):
        if index[start]:
            continue
        count += 1
        index[start] = low[start] = count
        open_.append(start)
        path.append(start)
        while path:
            x = path[-1]
            if rest[x] < at[x + 1]:
                y = targets[rest[x]]
                rest[x] += 1
                if not index[y]:
                    count += 1
                    index[y] = low[y] = count
                    open_.append(y)
                    path.append(y)
                elif label[y] < 0 and index[y] < low[x]:
                    low[x] = index[y]
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
            if low[x] == index[x]:
                members = [open_.pop()]
                while members[-1] != x:
                    members.append(open_.pop())
                least = min(members)
                for y in members:
                    label[y] = least
    return np.array(label, np.int64)


def _fewer(part: pa.Table) -> pa.Table:
    """Each strong component of these edges becomes one ring through its members, edges between two components one edge."""
    graphs = part["graph_id"].combine_chunks().dictionary_encode()
    both = pa.chunked_array([part["src"].combine_chunks(), part["tgt"].combine_chunks()]).combine_chunks().dictionary_encode()
    names, code = both.dictionary, both.indices.to_numpy().astype(np.int64)
    keys, ends = np.unique(np.tile(graphs.indices.to_numpy().astype(np.int64) << 32, 2) | code, return_inverse=True)
    s, t = ends[: len(part)], ends[len(part) :]
    label = strong_labels(len(keys), s, t)
    across = np.unique((label[s] << 32 | label[t])[label[s] != label[t]])
    order = np.argsort(label, kind="stable")
    first = np.concatenate([[True], np.diff(label[order]) != 0]) if len(order) else np.zeros(0, bool)
    # The next member, or the first where the component ends.
    onward = np.where(np.append(first[1:], True), label[order], np.append(order[1:], 0))
    ring = order != onward
    s, t = np.concatenate([order[ring], across >> 32]), np.concatenate([onward[ring], across & (1 << 32) - 1])
    of = lambda x: names.take(pa.array(keys[x] & (1 << 32) - 1))
    return pa.table({"graph_id": graphs.dictionary.take(pa.array(keys[s] >> 32)), "src": of(s), "tgt": of(t)})


def reduced(edges: DataFrame, small: int = SMALL, part: int = PART) -> DataFrame:
    """Fewer edges of which every node reaches the same nodes: each task reduces what it reads, again while that halves them and some graph has more than ``small``."""
    ship_package(edges.sparkSession)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names))  # without its word on nulls
            n += batch.num_rows
            if n >= part:
                held = _fewer(pa.Table.from_batches(held)).to_batches()
                n = sum(b.num_rows for b in held)
                if n > part // 2:  # too many to hold beside the next ones
                    yield from held
                    held, n = [], 0
        if n:
            yield from _fewer(pa.Table.from_batches(held)).to_batches()

    edges = edges.where("src <> tgt").select("graph_id", "src", "tgt")
    before = None
    while True:
        edges = materialize(edges.mapInArrow(solve, "graph_id string, src string, tgt string"))
        release(edges.sparkSession)
        left = edges.count()
        if before is not None and left > before / 2 or edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).isEmpty():
            return edges
        before = left
        edges = edges.coalesce(max(1, left // (4 * part)))  # a task reads the results of several


def split_reduced(edges: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """``split_by_size`` of edges of the same reach, fewer in large graphs."""
    few, many = split_by_size(edges, small)
    if many is None:
        return few, None
    less, many = split_by_size(reduced(many, small), small)
    return few.select("graph_id", "src", "tgt").union(less), many


def strong_components_of(successors: dict[str, list[str]]) -> list[list[str]]:
    """Kosaraju's two passes without recursion, over nodes in name order."""
    nodes = sorted({*successors, *(t for ts in successors.values() for t in ts)})
    order, seen = [], set()
    for start in nodes:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(successors.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            for t in rest:
                if t not in seen:
                    seen.add(t)
                    stack.append((t, iter(successors.get(t, ()))))
                    break
            else:
                order.append(node)
                stack.pop()
    back: dict[str, list[str]] = defaultdict(list)
    for s, ts in successors.items():
        for t in ts:
            back[t].append(s)
    out, placed = [], set()
    for start in reversed(order):
        if start in placed:
            continue
        placed.add(start)
        members, stack = [], [start]
        while stack:
            node = stack.pop()
            members.append(node)
            for s in back[node]:
                if s not in placed:
                    placed.add(s)
                    stack.append(s)
        out.append(members)
    return out


def _successors(group: pd.DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = defaultdict(list)
    for s, t in sorted(zip(group["src"], group["tgt"], strict=True)):
        out[s].append(t)
    return out


def _per_graph(edges: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    ship_package(edges.sparkSession)
    return edges.select("graph_id", "src", "tgt").groupBy("graph_id").applyInPandas(solve, schema)


def cycles(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """graph_id, id, cycle (smallest member), size, for the nodes of strong components of two nodes or more."""
    few, many = split_reduced(edges.where("src <> tgt"), small)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(group["graph_id"].iloc[0], x, min(c), len(c)) for c in strong_components_of(_successors(group)) if len(c) > 1 for x in c]
        return pd.DataFrame(rows, columns=["graph_id", "id", "cycle", "size"])

    out = _per_graph(few, solve, "graph_id string, id string, cycle string, size long")
    return out if many is None else out.union(_cycles_by_joins(many))


def _chained(edges: DataFrame, src: str, tgt: str) -> DataFrame:
    """graph_id, id of the nodes that nothing but a chain of single predecessors leads to, whatever its length: pointers double each round."""
    into = edges.groupBy("graph_id", F.col(tgt).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(src).alias("p"))
    single = materialize(into.where("n = 1").select("graph_id", "id", "p"))
    for _ in range(single.count().bit_length()):
        further = single.select("graph_id", F.col("id").alias("p"), F.col("p").alias("q"))
        single = materialize(single.join(further, ["graph_id", "p"], "left").select("graph_id", "id", F.coalesce("q", "p").alias("p")))
    return single.join(into.select("graph_id", F.col("id").alias("p")), ["graph_id", "p"], "left_anti").select("graph_id", "id")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    out = edges.join(nodes.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_anti")
    return out.join(nodes.withColumnRenamed("id", "tgt"), ["graph_id", "tgt"], "left_anti").select("graph_id", "src", "tgt")


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges from nodes that nothing reaches and to nodes that reach nothing, until none is left; chains go at once where a round drops little."""
    n = edges.count()
    while True:
        kept = edges.join(edges.select("graph_id", F.col("tgt").alias("src")).distinct(), ["graph_id", "src"], "left_semi")
        kept = materialize(kept.join(edges.select("graph_id", F.col("src").alias("tgt")).distinct(), ["graph_id", "tgt"], "left_semi").select("graph_id", "src", "tgt"))
        left = kept.count()
        if left == n:
            return kept
        if 0 < left and n - left < n / 10:
            kept = materialize(_without(kept, _chained(kept, "src", "tgt")))
            kept = materialize(_without(kept, _chained(kept, "tgt", "src")))
            left = kept.count()
        edges, n = kept, left


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label that reaches each node along the edges: labels (graph_id, id, label).

    Besides its predecessors a node asks one node further back, at a distance
    that doubles each round, so that a long path or cycle takes few rounds.
    """
    before = edges.groupBy("graph_id", F.col("tgt").alias("id")).agg(F.min("src").alias("p"))
    labels = materialize(labels.join(before, ["graph_id", "id"], "left").select("graph_id", "id", "label", "p"))
    state = None
    while True:
        far = labels.select("graph_id", F.col("id").alias("p"), F.col("label").alias("l"), F.col("p").alias("q"))
        jumped = labels.join(far, ["graph_id", "p"], "left").select("graph_id", "id", F.least("label", "l").alias("label"), F.coalesce("q", "p").alias("p"))
        moved = edges.join(labels.select("graph_id", F.col("id").alias("src"), "label"), ["graph_id", "src"]).select("graph_id", F.col("tgt").alias("id"), "label", F.lit(None).cast("string").alias("p"))
        labels = materialize(jumped.union(moved).groupBy("graph_id", "id").agg(F.min("label").alias("label"), F.max("p").alias("p")))
        new = labels.agg(F.sum(F.xxhash64("graph_id", "id", "label").cast("decimal(38,0)"))).first()
        if new == state:
            return labels.drop("p")
        state = new


def _cycles_by_joins(edges: DataFrame) -> DataFrame:
    """Each round colours nodes by the smallest node that reaches them; what goes back to a colour's node within the colour is its component."""
    spark, found = edges.sparkSession, []
    while True:
        edges = _trim(edges)
        if edges.isEmpty():
            break
        nodes = edges.select("graph_id", F.explode(F.array("src", "tgt")).alias("id")).distinct()
        colour = _spread(nodes.withColumn("label", F.col("id")), edges)
        inner = edges.join(colour.toDF("graph_id", "src", "cs"), ["graph_id", "src"]).join(colour.toDF("graph_id", "tgt", "ct"), ["graph_id", "tgt"]).where("cs = ct")
        back = materialize(inner.select("graph_id", F.col("tgt").alias("src"), F.col("src").alias("tgt")))
        # 0 at a colour's node, and so at whatever reaches it.
        reach = _spread(colour.select("graph_id", "id", F.when(F.col("id") == F.col("label"), 0).otherwise(1).alias("label")), back).where("label = 0").select("graph_id", "id")
        reach = materialize(reach.join(colour.withColumnRenamed("label", "cycle"), ["graph_id", "id"]))
        found.append(reach)
        edges = _without(edges, reach.select("graph_id", "id"))
    out = spark.createDataFrame([], "graph_id string, id string, cycle string")
    for f in found:
        out = out.union(f)
    sizes = out.groupBy("graph_id", "cycle").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return out.join(sizes, ["graph_id", "cycle"]).select("graph_id", "id", "cycle", "size")


def acyclicity(g: Graph, small: int = SMALL) -> DataFrame:
    """1 less the share of the nodes in scope that are in the largest cycle."""
    n = g.scope().groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    largest = cycles(g.inner_edges(), small).groupBy("graph_id").agg(F.max("size").alias("size"))
    out = n.join(largest, "graph_id", "left").select("graph_id", (1.0 - F.coalesce("size", F.lit(0)) / F.col("n")).alias("acyclicity"))
    return g.graphs().join(out, "graph_id", "left").select("graph_id", F.coalesce("acyclicity", F.lit(1.0)).alias("acyclicity"))


def reach_counts(edges: DataFrame, sources: DataFrame, small: int = SMALL, cyclic: DataFrame | None = None) -> DataFrame:
    """graph_id, id, reached: how many other nodes each source (graph_id, id) reaches; sources that reach none are left out. cyclic: the rows of ``cycles`` where they are known."""
    few, many = split_reduced(edges, small)

    def solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        successors, starts = _successors(left), sorted(right["id"])
        parts = strong_components_of(successors)  # each before those that it reaches
        place = {x: i for i, part in enumerate(parts) for x in part}
        onward = [{place[t] for x in part for t in successors.get(x, ())} - {i} for i, part in enumerate(parts)]
        rows = []
        for at in range(0, len(starts), SOURCES):
            some = [x for x in starts[at : at + SOURCES] if x in place]
            reached_by = [0] * len(parts)  # a bit for each source
            for bit, x in enumerate(some):
                reached_by[place[x]] |= 1 << bit
            total = np.zeros(len(some), np.int64)
            for i, part in enumerate(parts):
                if bits := reached_by[i]:
                    for j in onward[i]:
                        reached_by[j] |= bits
                    total += len(part) * np.unpackbits(np.frombuffer(bits.to_bytes(-(-len(some) // 8), "little"), np.uint8), bitorder="little")[: len(some)].astype(np.int64)
            rows += [(key[0], x, int(n) - 1) for x, n in zip(some, total, strict=True) if n > 1]
        return pd.DataFrame(rows, columns=["graph_id", "id", "reached"])

    ship_package(edges.sparkSession)
    # New names, as both sides may come from one table.
    left, right = few.select(F.col("graph_id").alias("g1"), "src", "tgt"), sources.select(F.col("graph_id").alias("g2"), F.col("id").alias("id"))
    out = left.groupBy("g1").cogroup(right.groupBy("g2")).applyInPandas(solve, "graph_id string, id string, reached long")
    return out if many is None else out.union(_reach_by_joins(many, sources, cyclic))


def _reach_by_joins(edges: DataFrame, sources: DataFrame, cyclic: DataFrame | None) -> DataFrame:
    """Each cycle is one node with its size. Sources go in bits, 64 to a word, along the edges between these nodes until no node gets a new one."""
    cyclic = materialize((_cycles_by_joins(edges.where("src <> tgt")) if cyclic is None else cyclic).select("graph_id", "id", "cycle"))
    release(edges.sparkSession)
    part = lambda df, c, out: df.join(cyclic.toDF("graph_id", c, "_cycle"), ["graph_id", c], "left").withColumn(out, F.coalesce("_cycle", c)).drop("_cycle")
    sizes = materialize(cyclic.groupBy("graph_id", F.col("cycle").alias("id")).agg(F.count(F.lit(1)).alias("size")))
    onward = materialize(part(part(edges.select("graph_id", "src", "tgt"), "src", "s"), "tgt", "t").where("s <> t").select("graph_id", F.col("s").alias("id"), "t").distinct())
    release(edges.sparkSession)
    # Sources in one cycle reach the same, so their cycle is one source.
    known = edges.select("graph_id", F.explode(F.array("src", "tgt")).alias("id")).distinct()
    starts = materialize(part(sources.select("graph_id", "id").join(known, ["graph_id", "id"], "left_semi"), "id", "start"))
    numbers = bl.numbered(starts.select("graph_id", F.col("start").alias("id")).distinct()).toDF("graph_id", "start", "k")
    bit = F.expr("shiftleft(1L, cast(k % 64 as int))")
    state = materialize(numbers.groupBy("graph_id", F.col("start").alias("id"), F.floor(F.col("k") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")))
    front = state
    while True:
        step = front.join(onward, ["graph_id", "id"]).groupBy("graph_id", F.col("t").alias("id"), "word").agg(F.bit_or("bits").alias("new"))
        both = materialize(state.join(step, ["graph_id", "id", "word"], "full").select("graph_id", "id", "word", F.coalesce("bits", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new")))
        front = both.select("graph_id", "id", "word", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("bits")).where("bits <> 0")
        if front.isEmpty():
            break
        state = both.select("graph_id", "id", "word", F.col("old").bitwiseOR(F.col("new")).alias("bits"))
    words = state.join(sizes, ["graph_id", "id"], "left").select("word", "bits", F.coalesce("size", F.lit(1)).alias("size"))
    counts = words.groupBy("word").agg(*[F.sum(F.when(F.expr(f"shiftright(bits, {b}) & 1") == 1, F.col("size"))).alias(f"b{b}") for b in range(64)])
    counts = counts.select(F.explode(F.array(*[F.struct((F.col("word") * 64 + b).cast("int").alias("k"), F.col(f"b{b}").alias("n")) for b in range(64)])).alias("c")).select("c.*")
    reached = starts.join(numbers.join(counts, "k"), ["graph_id", "start"])
    return reached.where("n > 1").select("graph_id", "id", (F.col("n") - 1).alias("reached"))


def cumulative_dependency(g: Graph, above: int | None = None, sample: int = 500, small: int = SMALL, cyclic: DataFrame | None = None) -> DataFrame:
    """ccd_raw, ccd_norm, avg_reachable: nodes reached from each node and itself, over n log2(n + 1), at most 10.

    All nodes count, whatever the graph's size. Only a caller that names
    ``above`` gets graphs of more nodes measured from ``sample`` nodes, those
    with the smallest hashes, and scaled up.
    """
    g = g.written()
    g = Graph(materialize(g.nodes), g.edges, g.edges_only)
    release(g.edges.sparkSession)
    chosen = scope = g.scope()
    n = scope.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    taken = F.col("n")
    if above is not None:
        place = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.xxhash64("id"), "id"))
        chosen = scope.join(n, "graph_id").withColumn("place", place).where((F.col("n") <= above) | (F.col("place") <= sample)).select("graph_id", "id")
        taken = F.when(F.col("n") > above, F.least(F.lit(sample), "n")).otherwise(F.col("n"))
    reached = reach_counts(g.inner_edges(), materialize(chosen), small, cyclic).groupBy("graph_id").agg(F.sum("reached").alias("r"))
    met = F.coalesce("r", F.lit(0)) + taken
    total = met if above is None else F.when(F.col("n") > above, F.floor(met * F.col("n") / taken)).otherwise(met)
    out = n.join(reached, "graph_id", "left").withColumn("raw", F.when(F.col("n") <= 1, F.lit(0)).otherwise(total))
    return out.select(
        "graph_id", F.col("raw").cast("long").alias("ccd_raw"),
        F.least(F.lit(10.0), F.col("raw") / (F.col("n") * F.log2(F.col("n") + 1))).alias("ccd_norm"), (F.col("raw") / F.col("n")).alias("avg_reachable"),
    )


def lcom4(methods: DataFrame, merge_names: bool = True) -> DataFrame:
    """class keys and lcom4: components of a class's methods that share attributes; 1 for a class without methods.

    methods: one row per method with graph_id, class, method, attrs (array); a
    null method stands for a class without methods. With ``merge_names``
    methods of one name are one node.
    """
    ship_package(methods.sparkSession)
    kind = methods.schema["class"].dataType.simpleString()
    schema = f"graph_id string, class {kind}, lcom4 long"
    arrow = to_arrow_schema(methods.sparkSession.createDataFrame([], schema).schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by class: one union-find at a time."""
        done: list[tuple] = []
        key, parent, n = None, {}, 0

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def close() -> None:
            if n:
                done.append((*key, max(1, len({find(x) for x in parent if x[0] == "m"}))))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for b in batches:
            for graph_id, name, method, attrs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (graph_id, name) != key:
                    close()
                    key, parent, n = (graph_id, name), {}, 0
                n += 1
                if method is None:
                    continue
                node = ("m", method if merge_names else n)
                parent.setdefault(node, node)
                for a in attrs or ():
                    parent.setdefault(("a", a), ("a", a))
                    parent[find(node)] = find(("a", a))
            if len(done) > 10_000:
                yield batch()
                done.clear()
        close()
        yield batch()

    rows = methods.select("graph_id", "class", "method", "attrs").repartition("graph_id", "class").sortWithinPartitions("graph_id", "class")
    return rows.mapInArrow(solve, schema)


def cohesion(lcom4_rows: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """1 less the mean penalty; a class with five components or more has the full penalty of 1; 1 without classes."""
    penalty = F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("lcom4") - 1) / 4.0)
    out = lcom4_rows.groupBy("graph_id").agg((1.0 - F.avg(penalty)).alias("cohesion"))
    return out if graphs is None else graphs.join(out, "graph_id", "left").select("graph_id", F.coalesce("cohesion", F.lit(1.0)).alias("cohesion"))


def communities(edges: DataFrame) -> DataFrame:
    """graph_id, id, community (smallest member): multi-level local moving over the undirected graph, in name order.

    A node moves to the neighbouring community with the largest gain in
    modularity, ties to the smallest name, until nothing moves; communities then
    become nodes. Sequential by nature: each graph is one task.
    """
    numbers = bl.numbered(edges.select("graph_id", F.explode(F.array("src", "tgt")).alias("id")).distinct())
    ends = bl.coded(edges.where("src <> tgt"), numbers)
    pairs = materialize(ends.select(F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y")).distinct())
    release(edges.sparkSession)
    rows = bl.rows_of(bl.undirected(pairs), numbers)
    release(edges.sparkSession)
    ship_package(edges.sparkSession)
    schema = "graph_id string, id string, community string"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by graph and number; a graph's neighbours are kept as one array of integers."""
        graph, names, numbers_, near, lengths = None, [], [], [], []

        def done() -> pa.Table:
            n = np.concatenate(numbers_)
            while near:  # into one array, a part at a time
                part = near.pop(0)
                links[filled[0] : filled[0] + len(part)] = part
                filled[0] += len(part)
            at = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            for i in range(0, len(links), bl.STEP):
                links[i : i + bl.STEP] = np.searchsorted(n, links[i : i + bl.STEP])
            id_ = pa.chunked_array(names).combine_chunks()
            return pa.table({"graph_id": pa.array([graph] * len(n), pa.string()), "id": id_, "community": id_.take(pa.array(local_moving(at, links)))})

        for batch in batches:
            i = 0
            graphs = batch["graph_id"].to_pylist()
            while i < len(graphs):
                if graphs[i] != graph and names:
                    links, filled = np.empty(sum(map(len, near)), np.int32), [0]
                    yield from done().to_batches(bl.OUT)
                    names, numbers_, near, lengths = [], [], [], []
                graph = graphs[i]
                j = i
                while j < len(graphs) and graphs[j] == graph:
                    j += 1
                some = batch.slice(i, j - i)
                names.append(some["id"])
                numbers_.append(some["n"].to_numpy())
                near.append(some["ws"].flatten().to_numpy())
                lengths.append(some["ws"].value_lengths().to_numpy())
                i = j
        if names:
            links, filled = np.empty(sum(map(len, near)), np.int32), [0]
            yield from done().to_batches(bl.OUT)

    return rows.repartition("graph_id").sortWithinPartitions("graph_id", "n").select("graph_id", "id", "n", "ws").mapInArrow(solve, schema)


def local_moving(at: np.ndarray, links: np.ndarray, passes: int = 100) -> np.ndarray:
    """Smallest member of the community of each node 0, 1, ...; its neighbours are links[at[x] : at[x + 1]], each once."""
    n = len(at) - 1
    weights = None  # all 1 at first
    member = np.arange(n)  # node to node of the present level
    total = float(len(links))
    while total:
        m = len(at) - 1
        place = np.arange(m)
        size = np.diff(at)
        degree = size.astype(np.float64) if weights is None else np.add.reduceat(np.append(weights, 0.0), at[:-1]) * (size > 0)
        mass = degree.copy()
        moved_any = False
        for _ in range(passes):
            moved = False
            for x in range(m):
                ys = links[at[x] : at[x + 1]]
                w = None if weights is None else weights[at[x] : at[x + 1]]
                if w is not None:
                    other = ys != x
                    ys, w = ys[other], w[other]
                old = place[x]
                mass[old] -= degree[x]
                found, which = np.unique(place[ys], return_inverse=True)
                to = np.bincount(which, w, minlength=len(found)).astype(np.float64)
                k = np.searchsorted(found, old)
                own = to[k] if k < len(found) and found[k] == old else 0.0
                best, gain = old, own - degree[x] * mass[old] / total
                new = to - degree[x] * mass[found] / total
                # In name order, as each must beat the last best by a margin.
                i = 0
                while True:
                    better = np.nonzero(new[i:] > gain + 1e-12)[0]
                    if not len(better):
                        break
                    i += int(better[0])
                    best, gain = found[i], new[i]
                mass[best] += degree[x]
                if best != old:
                    place[x], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            break
        _, first, group = np.unique(place, return_index=True, return_inverse=True)  # first: smallest node in each community
        order = np.argsort(first)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        group = rank[group]  # communities numbered by their smallest node
        member = group[member]
        # A node at a time, as all of them would not fit beside the links.
        rows = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[rows], np.arange(len(order) + 1))
        sums, near, heavy = np.zeros(len(order)), [], []
        for c in range(len(order)):
            touched = []
            for x in rows[cut[c] : cut[c + 1]]:
                found, which = np.unique(group[links[at[x] : at[x + 1]]], return_inverse=True)
                sums[found] += np.bincount(which, None if weights is None else weights[at[x] : at[x + 1]], minlength=len(found))
                touched.append(found)
            near.append(np.unique(np.concatenate(touched)).astype(np.int32))
            heavy.append(sums[near[-1]])
            sums[near[-1]] = 0.0
        at = np.concatenate([[0], np.cumsum([len(x) for x in near])])
        links, weights = np.concatenate(near), np.concatenate(heavy)
    smallest = np.full(n, n)
    np.minimum.at(smallest, member, np.arange(n))
    return smallest[member]
