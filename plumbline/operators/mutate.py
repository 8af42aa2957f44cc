"""Controlled changes of a dependency graph, for sensitivity studies: tables of edges in, tables of edges out.

The sample of each change is the rows with the smallest hashes of seed and
key, so a dose and a seed always give the same graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.operators.graph import Graph, package_instability
from plumbline.plans.lineage import materialize, release
from plumbline.plans.ordering import running_sum

TYPES = ("cycles", "layers", "hubs", "cohesion")


def _hash(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))


def _order(seed: int, *cols: str) -> list[Column]:
    return [_hash(seed, *cols), *[F.col(c) for c in cols]]


def _take(df: DataFrame, n: Column, seed: int, *cols: str, by: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """The first n rows of each graph in hash order; n may use the column total."""
    w = Window.partitionBy(*by)
    rows = df.withColumns({"total": F.count(F.lit(1)).over(w), "place": F.row_number().over(w.orderBy(*_order(seed, *cols)))})
    return rows.where(F.col("place") <= n).drop("total", "place")


def _placed(df: DataFrame, seed: int, *cols: str) -> DataFrame:
    """Adds place, from 1 in hash order in each graph, and total: for graphs with many rows. Rows are distinct in cols."""
    keyed = df.withColumns({"order": F.struct(_hash(seed, *cols), *cols), "one": F.lit(1)})
    totals = df.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"))
    return running_sum(keyed, ["graph_id"], "order", "one", "place").drop("order", "one").join(totals, "graph_id")


def _package_edges(g: Graph) -> DataFrame:
    inner = g.inner_edges().select("graph_id", names.package(F.col("src")).alias("p"), names.package(F.col("tgt")).alias("q"), "src", "tgt")
    return inner.where("p <> q").groupBy("graph_id", "p", "q").agg(F.min("src").alias("src"), F.min("tgt").alias("tgt"))


def _one_way(g: Graph) -> DataFrame:
    """Package pairs with imports one way only."""
    pairs = _package_edges(g)
    back = pairs.select("graph_id", F.col("q").alias("p"), F.col("p").alias("q"))
    return pairs.join(back, ["graph_id", "p", "q"], "left_anti")


def inject_cycles(g: Graph, dose: float, seed: int) -> DataFrame:
    """New edges: for a share of the package pairs with imports one way only, one import back."""
    return _back(_placed(_one_way(g), seed, "p", "q"), dose)


def _back(placed: DataFrame, dose: float) -> DataFrame:
    taken = placed.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("total") * dose)))
    return taken.select("graph_id", F.col("tgt").alias("src"), F.col("src").alias("tgt"))


def inject_layer_violations(g: Graph, dose: float, seed: int, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """New edges from stable packages (lowest third of instability, below ``low``) to unstable ones (highest third, above ``high``).

    Graphs with fewer than four nodes in scope or three packages get none.
    """
    w = Window.partitionBy("graph_id")
    ranked = package_instability(Graph(g.nodes.join(g.scope(), ["graph_id", "id"], "left_semi"), g.inner_edges()))
    ranked = ranked.withColumns({"n": F.count(F.lit(1)).over(w), "k": F.row_number().over(w.orderBy("instability", "package"))})
    enough = g.scope().groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 4")
    ranked = ranked.where("n >= 3").join(enough.select("graph_id"), "graph_id", "left_semi")
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    member = g.scope().groupBy("graph_id", names.package(F.col("id")).alias("package")).agg(F.min("id").alias("id"))
    ranked = ranked.join(member, ["graph_id", "package"])
    stable = ranked.where((F.col("k") <= third) & (F.col("instability") < low)).select("graph_id", F.col("id").alias("src"))
    unstable = ranked.where((F.col("k") > F.col("n") - third) & (F.col("instability") > high)).select("graph_id", F.col("id").alias("tgt"))
    fresh = stable.join(unstable, "graph_id").where("src <> tgt").join(g.edges, ["graph_id", "src", "tgt"], "left_anti")
    return _take(fresh, F.greatest(F.lit(1), F.floor(F.col("total") * dose)), seed, "src", "tgt")


def create_hubs(g: Graph, dose: float, seed: int) -> DataFrame:
    """New edges: a few nodes (at least 1, dose times 5 % of them) that import nodes of other packages (3 to dose times 20).

    Graphs with fewer than ten nodes in scope get none.
    """
    enough = g.scope().groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 10")
    nodes = g.scope().join(enough.select("graph_id"), "graph_id", "left_semi")
    hubs = _take(nodes, F.greatest(F.lit(1), F.floor(F.col("total") * dose * 0.05)), seed, "id").select("graph_id", F.col("id").alias("src"))
    targets = _take(nodes, F.lit(40), seed + 1, "id").select("graph_id", F.col("id").alias("tgt"))
    foreign = hubs.join(targets, "graph_id").where(names.package(F.col("src")) != names.package(F.col("tgt")))
    taken = _take(foreign, F.greatest(F.lit(3), F.floor(F.least(F.lit(20), F.col("total")) * dose)), seed, "tgt", by=("graph_id", "src"))
    return taken.join(g.edges, ["graph_id", "src", "tgt"], "left_anti").select("graph_id", "src", "tgt")


def move_modules(g: Graph, dose: float, seed: int) -> DataFrame:
    """graph_id, id, moved: new names of a share of the nodes, in the package of another node."""
    taken = _take(g.scope(), F.greatest(F.lit(1), F.floor(F.col("total") * dose)), seed, "id")
    hosts = g.scope().select("graph_id", names.package(F.col("id")).alias("host")).distinct()
    w = Window.partitionBy("graph_id")
    hosts = hosts.withColumns({"slot": F.row_number().over(w.orderBy("host")) - 1, "n": F.count(F.lit(1)).over(w)})
    sizes = hosts.select("graph_id", "n").distinct()
    slot = (F.conv(F.substring(_hash(seed, "id"), 1, 8), 16, 10).cast("long") % F.col("n")).cast("int")
    leaf = F.element_at(F.split("id", r"\."), -1)
    return taken.join(sizes, "graph_id").withColumn("slot", slot).drop("n").join(hosts.drop("n"), ["graph_id", "slot"]).where(names.package(F.col("id")) != F.col("host")).select("graph_id", "id", F.concat_ws(".", "host", leaf).alias("moved"))


def degrade_cohesion(g: Graph, dose: float, seed: int) -> Graph:
    moved = move_modules(g, dose, seed)
    rename = lambda df, c: df.join(moved.toDF("graph_id", c, "_new"), ["graph_id", c], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return Graph(rename(g.nodes, "id").select("graph_id", "id", "internal"), rename(rename(g.edges, "src"), "tgt").select("graph_id", "src", "tgt").distinct())


def mutated(g: Graph, kind: str, dose: float, seed: int) -> Graph:
    if kind == "cohesion":
        return degrade_cohesion(g, dose, seed)
    return Graph(g.nodes, g.edges.union(_more(g, kind, dose, seed)), g.edges_only)


def _more(g: Graph, kind: str, dose: float, seed: int) -> DataFrame:
    """The new edges of a change that only adds some: none is there already, and they join nodes of the graph."""
    more = {"cycles": inject_cycles, "layers": inject_layer_violations, "hubs": create_hubs}[kind](g, dose, seed)
    return more.select("graph_id", "src", "tgt")


def study(g: Graph, kinds: tuple[str, ...], doses: tuple[float, ...], seeds: tuple[int, ...]) -> Graph:
    """All combinations in one graph table: graph_id becomes ``graph/kind/dose/seed``, so any operator measures them in one pass.

    Only new edges are written for each; the graph's own edges are written once and get all names as they are read.
    """
    g = g.written()
    g = Graph(materialize(g.nodes), g.edges, g.edges_only)
    name = lambda kind, dose, seed: F.concat_ws("/", "graph_id", F.lit(kind), F.lit(str(dose)), F.lit(str(seed)))
    nodes, edges, grown = [], [], []
    for kind in kinds:
        one_way = materialize(_one_way(g)) if kind == "cycles" else None
        for seed in seeds:
            placed = materialize(_placed(one_way, seed, "p", "q")) if kind == "cycles" else None
            for dose in doses:
                # Written one by one: a plan of all of them would outgrow the driver.
                if kind == "cohesion":
                    m = degrade_cohesion(g, dose, seed)
                    nodes.append(materialize(m.nodes.withColumn("graph_id", name(kind, dose, seed))))
                    edges.append(materialize(m.edges.withColumn("graph_id", name(kind, dose, seed))))
                else:
                    more = _more(g, kind, dose, seed) if placed is None else _back(placed, dose)
                    edges.append(materialize(more.withColumn("graph_id", name(kind, dose, seed))))
                    grown.append(name(kind, dose, seed))
            release(g.edges.sparkSession)
    if grown:
        nodes.append(g.nodes.select(F.explode(F.array(*grown)).alias("graph_id"), "id", "internal"))
        edges.append(g.edges.select(F.explode(F.array(*grown)).alias("graph_id"), "src", "tgt"))
    return Graph(reduce(DataFrame.union, nodes), reduce(DataFrame.union, edges), g.edges_only)
