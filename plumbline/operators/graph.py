"""Metrics of dependency graphs as relational operators over nodes and edges.

A graph's nodes have (graph_id, id, internal); its edges (graph_id, src, tgt)
are distinct. Where a graph marks no node as internal, all its nodes count.
Operators return one row per graph unless they say otherwise; graphs without
edges keep their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.operators import blocks as bl
from plumbline.plans.lineage import materialize, release


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    #: All nodes are ends of edges and none is internal, so that all are in scope: known where only edges were given.
    edges_only: bool = False

    @classmethod
    def of_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, distinct: bool = False) -> Graph:
        """From edges with or without graph_id, known to be distinct or not; nodes that only edges name aren't internal."""
        if "graph_id" not in edges.columns:
            edges = edges.withColumn("graph_id", F.lit("g"))
        edges = edges.select("graph_id", "src", "tgt")
        edges = edges if distinct else edges.distinct()
        named = edges.select("graph_id", F.explode(F.array("src", "tgt")).alias("id"), F.lit(False).alias("internal"))
        if nodes is not None:
            if "graph_id" not in nodes.columns:
                nodes = nodes.withColumn("graph_id", F.lit("g"))
            named = named.union(nodes.select("graph_id", "id", F.coalesce("internal", F.lit(False))))
        return cls(named.groupBy("graph_id", "id").agg(F.max("internal").alias("internal")), edges, nodes is None)

    def written(self) -> Graph:
        """The same graph from tables on disk: later steps neither compute its edges again nor add to the shuffle files of those that made them."""
        edges = materialize(self.edges)
        nodes = None if self.edges_only else materialize(self.nodes)
        release(edges.sparkSession)
        return Graph.of_edges(edges, distinct=True) if nodes is None else Graph(nodes, edges)

    def scope(self) -> DataFrame:
        """graph_id, id of the internal nodes, or of all nodes of graphs that mark none."""
        if self.edges_only:
            return self.nodes.select("graph_id", "id")
        marked = self.nodes.groupBy("graph_id").agg(F.max("internal").alias("marked"))
        return self.nodes.join(marked, "graph_id").where("internal or not marked").select("graph_id", "id")

    def inner_edges(self) -> DataFrame:
        """Edges between nodes in scope."""
        if self.edges_only:
            return self.edges
        inside = self.scope()
        return self.edges.join(inside.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(inside.withColumnRenamed("id", "tgt"), ["graph_id", "tgt"], "left_semi")

    def scoped_edges(self) -> DataFrame:
        """Edges from nodes in scope."""
        return self.edges if self.edges_only else self.edges.join(self.scope().withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi")

    def graphs(self) -> DataFrame:
        return self.nodes.select("graph_id").distinct()


def instability(outgoing: Column, incoming: Column) -> Column:
    """Share of outgoing dependencies; one half for an isolated one."""
    return F.coalesce(F.try_divide(outgoing, outgoing + incoming), F.lit(0.5))


def _degrees(g: Graph, name, counts: Column, out: str) -> DataFrame:
    """Incoming and outgoing edges that count, by a function of the node's name: one aggregation, which keeps those without any."""
    n = counts.cast("int")
    parts = g.edges.select("graph_id", name(F.col("src")).alias(out), n.alias("o"), F.lit(0).alias("i")).union(g.edges.select("graph_id", name(F.col("tgt")), F.lit(0), n))
    if not g.edges_only:
        parts = parts.union(g.nodes.select("graph_id", name(F.col("id")), F.lit(0), F.lit(0)))
    return parts.groupBy("graph_id", out).agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def degrees(g: Graph) -> DataFrame:
    """graph_id, id, fan_in, fan_out of every node; a loop counts once in each."""
    return _degrees(g, lambda c: c, F.lit(True), "id")


def package_instability(g: Graph) -> DataFrame:
    """graph_id, package, fan_in, fan_out (edges across packages), instability."""
    crossing = names.package(F.col("src")) != names.package(F.col("tgt"))
    return _degrees(g, names.package, crossing, "package").withColumn("instability", instability(F.col("fan_out"), F.col("fan_in")))


def stability(g: Graph) -> DataFrame:
    """Variance of the packages' instability over one quarter, at most 1; 0 for a single package."""
    return package_instability(g).groupBy("graph_id").agg(
        F.when(F.count(F.lit(1)) <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.var_pop("instability") / 0.25)).alias("stability")
    )


def instability_variance(g: Graph) -> DataFrame:
    """The same by node; 1 for a single node."""
    rows = degrees(g).withColumn("instability", instability(F.col("fan_out"), F.col("fan_in")))
    return rows.groupBy("graph_id").agg(F.when(F.count(F.lit(1)) <= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.var_pop("instability") / 0.25)).alias("instability_variance"))


def package_depth(g: Graph) -> DataFrame:
    """graph_id, depth: one less than the mean number of parts of dotted names, between 1 and 4."""
    parts = F.when(F.col("id").contains("."), F.size(F.split("id", r"\.")))
    return g.nodes.groupBy("graph_id").agg(F.coalesce(F.greatest(F.lit(1), F.least(F.lit(4), F.bround(F.avg(parts), 0).cast("int") - 1)), F.lit(1)).alias("depth"))


def boundary_crossing(g: Graph) -> DataFrame:
    """1 less the share of edges from nodes in scope that leave their package; one half without edges."""
    sources = g.scoped_edges().join(package_depth(g), "graph_id")
    crosses = names.package_at(F.col("src"), F.col("depth")) != names.package_at(F.col("tgt"), F.col("depth"))
    share = sources.groupBy("graph_id").agg((1.0 - F.avg(crosses.cast("double"))).alias("r"))
    return g.graphs().join(share, "graph_id", "left").select("graph_id", F.coalesce("r", F.lit(0.5)).alias("boundary_crossing"))


def edge_similarity(g: Graph, block: int | None = None) -> DataFrame:
    """graph_id, src, tgt, shared, similarity: Jaccard similarity of the neighbour sets of an edge's ends.

    Neighbours are counted in blocks of nodes, without a row for each common one.
    """
    numbers = bl.numbered(g.nodes)
    ends = lambda e, wanted: e.select(F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"), (F.lit(wanted) & (F.col("s") <= F.col("t"))).alias("forth"), (F.lit(wanted) & (F.col("s") > F.col("t"))).alias("back"))
    both = ends(bl.coded(g.edges, numbers), g.edges_only)
    if not g.edges_only:
        both = both.union(ends(bl.coded(g.scoped_edges(), numbers), True))
    pairs = materialize(both.groupBy("x", "y").agg(F.max("forth").alias("forth"), F.max("back").alias("back")))
    release(g.edges.sparkSession)
    found = bl.overlaps_of(pairs.where("forth or back"), bl.rows_of(bl.undirected(pairs), numbers), block)
    ways = F.explode(F.array_compact(F.array(F.when(F.col("forth"), F.struct("a", "b")), F.when(F.col("back"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))
    return found.select("graph_id", ways.alias("e"), "shared", "similarity").select("graph_id", F.col("e.a").alias("src"), F.col("e.b").alias("tgt"), "shared", "similarity")


def _coupling(values: DataFrame, g: Graph, x: str) -> DataFrame:
    out = values.groupBy("graph_id").agg(F.avg(x).alias("mean_ic"), F.max(x).alias("max_ic"), F.avg((F.col(x) > 0.5).cast("double")).alias("ic_above_05"), F.count(F.lit(1)).alias("n_pairs"))
    zero = F.lit(0.0)
    return g.graphs().join(out, "graph_id", "left").select("graph_id", *[F.coalesce(c, zero).alias(c) for c in ("mean_ic", "max_ic", "ic_above_05")], F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def indirect_coupling(g: Graph) -> DataFrame:
    """Mean and largest edge similarity and the share above one half; zeros count."""
    return _coupling(edge_similarity(g), g, "similarity")


def profile_similarity(g: Graph, block: int | None = None) -> DataFrame:
    """graph_id, a, b, shared, similarity of the import sets of nodes in scope that share an import, a before b."""
    g = g.written()
    numbers = bl.numbered(g.nodes)
    release(g.edges.sparkSession)
    rows = bl.rows_of(bl.coded(g.scoped_edges(), numbers).toDF("n", "w"), numbers)
    release(g.edges.sparkSession)
    return bl.all_overlaps(rows, block).select("graph_id", "a", "b", "shared", "similarity")


def profile_coupling(g: Graph) -> DataFrame:
    return _coupling(profile_similarity(g), g, "similarity")


def module_metrics(g: Graph, cyclic: DataFrame) -> DataFrame:
    """graph_id, id, fan_in, fan_out, instability, in_cycle of the nodes in scope. cyclic: (graph_id, id) of nodes in cycles."""
    rows = degrees(g) if g.edges_only else degrees(g).join(g.scope(), ["graph_id", "id"], "left_semi")
    rows = rows.join(cyclic.select("graph_id", "id", F.lit(True).alias("c")), ["graph_id", "id"], "left")
    return rows.select("graph_id", "id", "fan_in", "fan_out", instability(F.col("fan_out"), F.col("fan_in")).alias("instability"), F.coalesce("c", F.lit(False)).alias("in_cycle"))


def module_summary(modules: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return modules.groupBy("graph_id").agg(
        n.alias("n_modules"), F.avg("fan_in").alias("avg_fan_in"), F.max("fan_in").alias("max_fan_in"), F.avg("fan_out").alias("avg_fan_out"), F.max("fan_out").alias("max_fan_out"),
        F.when(n > 1, F.stddev_samp("fan_out")).otherwise(0.0).alias("fan_out_std"), F.sum(F.col("in_cycle").cast("long")).alias("n_in_scc"), F.avg(F.col("in_cycle").cast("double")).alias("scc_fraction"),
    )


def top_modules(modules: DataFrame, n: int = 50) -> DataFrame:
    """The n modules with the largest fan-out of each graph; ties by name."""
    ranked = modules.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("fan_out"), "id")))
    return ranked.where(F.col("place") <= n)


def dominant_internal(g: Graph, share: float = 0.6, tests: str = r"(?i)(^|[._/])tests?([._/]|$)") -> DataFrame:
    """graph_id, id of the nodes taken for internal where files aren't known.

    Roots of dotted names by size until they cover ``share`` of them; test
    names are left out. Graphs without dotted names keep all nodes.
    """
    marked = g.nodes.groupBy("graph_id").agg(F.max("internal").alias("marked"), F.max(F.col("id").contains(".")).alias("dotted"))
    roots = g.nodes.where(F.col("id").contains(".")).groupBy("graph_id", names.top(F.col("id")).alias("root")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("graph_id").orderBy(F.desc("n"), "root").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("graph_id"))
    kept = roots.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)) / total).where(F.col("before") < share).select("graph_id", "root", F.lit(True).alias("k"))
    nodes = g.nodes.withColumn("root", names.top(F.col("id"))).join(marked, "graph_id").join(kept, ["graph_id", "root"], "left")
    wanted = F.when(F.col("marked"), F.col("internal")).when(~F.col("dotted"), F.lit(True)).otherwise(F.col("k").isNotNull() & ~F.col("id").rlike(tests))
    return nodes.where(wanted).select("graph_id", "id")


def internal_with_targets(g: Graph) -> Graph:
    """The internal nodes, their direct targets, and the edges among these."""
    inside = g.nodes.where("internal").select("graph_id", "id")
    wide = inside.union(g.edges.join(inside.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").select("graph_id", F.col("tgt").alias("id"))).distinct()
    edges = g.edges.join(wide.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(wide.withColumnRenamed("id", "tgt"), ["graph_id", "tgt"], "left_semi")
    return Graph(g.nodes.join(wide, ["graph_id", "id"], "left_semi"), edges)


def newman_q(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Modularity of a given partition (graph_id, id, community) over the undirected simple graph without loops."""
    pairs = edges.where("src <> tgt").select("graph_id", F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
    joined = pairs.join(membership.toDF("graph_id", "a", "ca"), ["graph_id", "a"]).join(membership.toDF("graph_id", "b", "cb"), ["graph_id", "b"])
    ends = joined.select("graph_id", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), 1).otherwise(0).alias("l")), F.struct(F.col("cb").alias("c"), F.lit(0).alias("l")))).alias("x"))
    by = ends.groupBy("graph_id", "x.c").agg(F.sum("x.l").alias("inside"), F.count(F.lit(1)).alias("degree"))
    m = F.sum("degree") / 2.0
    return by.groupBy("graph_id").agg((F.sum("inside") / m - F.sum(F.pow(F.col("degree").cast("double"), F.lit(2))) / F.pow(2.0 * m, F.lit(2))).alias("modularity_q"))
