"""Boundaries between groups of modules: proposed rules, checked rules, and the ratchet gate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.operators.graph import Graph, dominant_internal
from plumbline.operators.traversal import communities

TESTS = r"(?i)(^|[._/])tests?([._/]|$)"


def rules_table(spark: SparkSession, rules: Iterable[Mapping[str, str]]) -> DataFrame:
    """name, type, pattern_from, pattern_to, from_regex, to_regex, root: rules are few and written by people."""
    rows = [
        (r.get("name", ""), r.get("type", "forbidden"), r["from"], r["to"], names.glob_regex(r["from"]), names.glob_regex(r["to"]), names.literal_root(r["from"]))
        for r in rules
    ]
    return spark.createDataFrame(rows, "name string, type string, pattern_from string, pattern_to string, from_regex string, to_regex string, root string")


def violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per forbidden rule and edge that both of its patterns match, on path forms.

    Rules with a literal first segment meet edges by that segment in a hash
    join; the few without one are tested one by one, as columns of the edges.
    """
    forbidden = rules.where("type = 'forbidden'")
    out = ["graph_id", "src", "tgt", "name", "pattern_from", "pattern_to"]
    paths = edges.withColumns({"from_path": names.path_form(F.col("src")), "to_path": names.path_form(F.col("tgt"))})
    paths = paths.withColumn("root", F.substring_index("from_path", "/", 1))
    rooted = paths.join(forbidden.where("root is not null"), "root").where("rlike(from_path, from_regex) and rlike(to_path, to_regex)").select(*out)
    free = forbidden.where("root is null").select("name", "pattern_from", "pattern_to", "from_regex", "to_regex").collect()
    hits = [F.when(F.col("from_path").rlike(r["from_regex"]) & F.col("to_path").rlike(r["to_regex"]), F.struct(F.lit(r["name"]).alias("name"), F.lit(r["pattern_from"]).alias("pattern_from"), F.lit(r["pattern_to"]).alias("pattern_to"))) for r in free]
    if not hits:
        return rooted
    loose = paths.select("graph_id", "src", "tgt", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("r")).select("graph_id", "src", "tgt", "r.*")
    return rooted.union(loose.select(*out))


def constraint_score(edges: DataFrame, found: DataFrame) -> DataFrame:
    """graph_id, n_edges, n_violations, constraint_score: 1 less violations over edges, at least 0."""
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    v = found.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_violations"))
    n = F.coalesce("n_violations", F.lit(0))
    return e.join(v, "graph_id", "left").select("graph_id", "n_edges", n.alias("n_violations"), F.greatest(F.lit(0.0), 1.0 - n / F.col("n_edges")).alias("constraint_score"))


def direction(a_to_b: Column, b_to_a: Column) -> Column:
    """Struct of confidence and direction of the dependency between two groups, from the edges each way."""
    total, most = a_to_b + b_to_a, F.greatest(a_to_b, b_to_a)
    make = lambda c, d: F.struct(F.lit(c).alias("confidence"), (d if isinstance(d, Column) else F.lit(d)).alias("direction"))
    return (
        F.when(total == 0, make(0.9, "isolated"))
        .when((a_to_b > 0) & (b_to_a == 0), make(0.85, "a_to_b"))
        .when((b_to_a > 0) & (a_to_b == 0), make(0.85, "b_to_a"))
        .when(most * 10 >= total * 9, make(0.6, F.when(a_to_b > b_to_a, F.lit("a_to_b")).otherwise(F.lit("b_to_a"))))
        .otherwise(make(0.3, "bidirectional"))
    )


def label_communities(members: DataFrame) -> DataFrame:
    """graph_id, community, label, size: the common dotted prefix if it has two parts or more; else the most common two parts if five members or more have it over 40 %; else the prefix; else the most common root."""
    keys = ["graph_id", "community"]
    base = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), names.common_prefix(F.min("id"), F.max("id")).alias("prefix"))
    def mode(name: Column, out: str) -> DataFrame:
        counts = members.where(name.isNotNull()).groupBy(*keys, name.alias("x")).agg(F.count(F.lit(1)).alias("n"))
        best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "x"))
        return counts.withColumn("k", best).where("k = 1").select(*keys, F.col("x").alias(out), F.col("n").alias(f"{out}_n"))

    two = mode(F.when(F.col("id").contains("."), names.package(F.col("id"))), "two")
    one = mode(names.top(F.col("id")), "one")
    out = base.join(two, keys, "left").join(one, keys, "left")
    label = (
        F.when(F.col("prefix").contains("."), F.col("prefix"))
        .when((F.col("size") >= 5) & (F.col("two_n") / F.col("size") > 0.4), F.col("two"))
        .when(F.col("prefix") != "", F.col("prefix")).otherwise(F.col("one"))
    )
    return out.select(*keys, label.alias("label"), "size")


def cluster_members(g: Graph, min_size: int = 3) -> DataFrame:
    """graph_id, id, label: communities of the internal nodes; those of one label are merged, tests and small ones left out."""
    inside = dominant_internal(g)
    edges = g.edges.join(inside.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(inside.withColumnRenamed("id", "tgt"), ["graph_id", "tgt"], "left_semi")
    members = communities(edges)
    labels = label_communities(members).where((F.col("size") >= min_size) & ~F.col("label").rlike(TESTS))
    return members.join(labels, ["graph_id", "community"]).select("graph_id", "id", "label")


def cross_edges(g: Graph, membership: DataFrame) -> DataFrame:
    """graph_id, a, b, a_to_b, b_to_a of all pairs of groups a before b, also those without edges. membership: graph_id, id, label."""
    joined = g.edges.join(membership.toDF("graph_id", "src", "ls"), ["graph_id", "src"]).join(membership.toDF("graph_id", "tgt", "lt"), ["graph_id", "tgt"]).where("ls <> lt")
    counts = joined.groupBy("graph_id", F.least("ls", "lt").alias("a"), F.greatest("ls", "lt").alias("b")).agg(
        F.count(F.when(F.col("ls") < F.col("lt"), 1)).alias("a_to_b"), F.count(F.when(F.col("ls") > F.col("lt"), 1)).alias("b_to_a")
    )
    labels = membership.select("graph_id", "label").distinct()
    pairs = labels.toDF("graph_id", "a").join(labels.toDF("graph_id", "b"), "graph_id").where("a < b")
    return pairs.join(counts, ["graph_id", "a", "b"], "left").fillna(0, ["a_to_b", "b_to_a"])


def _proposals(pairs: DataFrame, min_confidence: float) -> DataFrame:
    rows = pairs.withColumn("d", direction(F.col("a_to_b"), F.col("b_to_a"))).select("graph_id", "a", "b", "a_to_b", "b_to_a", "d.*").where(F.col("confidence") >= min_confidence)
    forbid = lambda x, y: F.struct(F.concat(x, F.lit("/*")).alias("rule_from"), F.concat(y, F.lit("/*")).alias("rule_to"), x.alias("label_from"), y.alias("label_to"))
    a, b = F.col("a"), F.col("b")
    made = F.when(F.col("direction") == "isolated", F.array(forbid(a, b), forbid(b, a))).when(F.col("direction") == "a_to_b", F.array(forbid(b, a))).when(F.col("direction") == "b_to_a", F.array(forbid(a, b)))
    return rows.select("graph_id", F.explode(made).alias("r"), "confidence", "direction", "a_to_b", "b_to_a").select("graph_id", "r.*", "confidence", "direction", "a_to_b", "b_to_a").dropDuplicates(["graph_id", "rule_from", "rule_to"])


def propose_rules(pairs: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """graph_id, rule_from, rule_to, confidence, direction, a_to_b, b_to_a: forbid the reverse of a one-way dependency, and both ways between isolated groups."""
    return _proposals(pairs, min_confidence).drop("label_from", "label_to")


def explain_rules(pairs: DataFrame, membership: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """``propose_rules`` with the sizes of both groups, the edges that speak for the rule, and the reason in words."""
    sizes = membership.groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("size"))
    rows = _proposals(pairs, min_confidence).withColumn("edges", F.greatest("a_to_b", "b_to_a"))
    rows = rows.join(sizes.toDF("graph_id", "label_from", "size_from"), ["graph_id", "label_from"]).join(sizes.toDF("graph_id", "label_to", "size_to"), ["graph_id", "label_to"])
    apart = F.format_string("%s and %s don't depend on each other", "label_from", "label_to")
    one_way = F.format_string("%s depends on %s by %d of %d edges", "label_to", "label_from", "edges", F.col("a_to_b") + F.col("b_to_a"))
    reason = F.when(F.col("direction") == "isolated", apart).otherwise(one_way)
    return rows.select("graph_id", "rule_from", "rule_to", "confidence", "direction", "size_from", "size_to", "a_to_b", "b_to_a", reason.alias("rationale"))


def discover(g: Graph, min_confidence: float = 0.5, min_size: int = 3) -> DataFrame:
    return propose_rules(cross_edges(g, cluster_members(g, min_size)), min_confidence)


def ratchet(current: DataFrame, baseline: DataFrame | None, watched: Iterable[str], delta: float = 0.0) -> DataFrame:
    """graph_id, metric, value, baseline, passed: a value passes if it isn't below the baseline less delta, or has none."""
    def long(df: DataFrame, value: str) -> DataFrame:
        return df.select("graph_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(value)) for m in watched])).alias("x")).select("graph_id", "x.*")

    out = long(current, "value")
    out = out.join(long(baseline, "baseline"), ["graph_id", "metric"], "left") if baseline is not None else out.withColumn("baseline", F.lit(None).cast("double"))
    return out.withColumn("passed", F.coalesce(F.col("value") >= F.col("baseline") - delta, F.lit(True)))
