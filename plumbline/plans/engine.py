"""The engine's main entry points: measure projects, discover boundaries, gate a change, report."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.operators import graph as gr
from plumbline.operators import policy
from plumbline.operators import traversal as tr
from plumbline.plans.lineage import materialize
from plumbline.sources import code

#: The published weights of modularity, acyclicity, stability and cohesion.
CALIBRATED = (0.0, 0.7304, 0.05, 0.174)


#: Fixed value: the Q that counts as fully modular.
FULL_Q = 0.75
#: Fixed value: the confidence from which a proposed rule is ready for use.
SURE = 0.7


def modularity(g: gr.Graph, membership: DataFrame | None = None) -> DataFrame:
    """Newman's Q over 0.75, from 0 to 1; 1 for a graph without edges or with one node, one half below ten nodes.

    membership: graph_id, id, community; without it the communities are found.
    """
    size = g.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    edges = g.edges.where("src <> tgt")
    q = gr.newman_q(edges, tr.communities(edges) if membership is None else membership)
    n = F.col("n")
    value = F.when((n <= 1) | F.col("modularity_q").isNull(), 1.0).when(n < 10, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("modularity_q")) / FULL_Q))
    return size.join(q, "graph_id", "left").select("graph_id", value.alias("modularity"))


def measure(g: gr.Graph, lcom4: DataFrame | None = None, languages: DataFrame | None = None, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25), membership: DataFrame | None = None) -> DataFrame:
    """One row per graph: the four metrics, their composite score, nodes, edges and language.

    lcom4: graph_id, lcom4 of classes; without it cohesion is 1. languages:
    graph_id, language; without it the language is null. membership: communities
    that are known already.
    """
    sizes = g.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    edges = g.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    out = sizes.join(edges, "graph_id", "left").fillna(0, ["edges"])
    for part in (modularity(g, membership), tr.acyclicity(g), gr.stability(g)):
        out = out.join(part, "graph_id", "left")
    out = out.join(tr.cohesion(lcom4), "graph_id", "left") if lcom4 is not None else out.withColumn("cohesion", F.lit(None).cast("double"))
    out = out.withColumn("cohesion", F.coalesce("cohesion", F.lit(1.0)))
    out = out.join(languages, "graph_id", "left") if languages is not None else out.withColumn("language", F.lit(None).cast("string"))
    names = ("modularity", "acyclicity", "stability", "cohesion")
    return out.withColumn("score", scores.composite([F.col(c) for c in names], weights))


def extended(g: gr.Graph) -> DataFrame:
    """Ripple effect, indirect coupling and the module summary of each graph."""
    g = g.written()
    g = gr.Graph(materialize(g.nodes), g.edges, g.edges_only)
    cyclic = materialize(tr.cycles(g.inner_edges()))
    modules = gr.module_metrics(g, cyclic)
    return tr.cumulative_dependency(g, cyclic=cyclic).join(gr.indirect_coupling(g), "graph_id").join(gr.module_summary(modules), "graph_id").join(gr.boundary_crossing(g), "graph_id")


def scan(files: DataFrame) -> tuple[gr.Graph, DataFrame, DataFrame]:
    """Graph, class components and languages of source files (graph_id, path, text)."""
    kept = code.keep_sources(files)
    languages = code.detect_language(kept)
    endings = F.create_map(*[F.lit(x) for pair in code.EXTENSIONS.items() for x in pair])
    own = kept.join(languages, "graph_id").where(code.extension(F.col("path")) == endings[F.col("language")]).drop("language")
    parsed = code.parse(own, code.source_root(files))
    return gr.Graph.of_edges(code.module_edges(parsed), code.module_nodes(parsed)), tr.lcom4(code.class_methods(parsed)), languages


def score_files(files: DataFrame) -> DataFrame:
    return scores.enhance(measure(*scan(files)))


def gate(current: DataFrame, least: float | None = None, baseline: DataFrame | None = None, watched: Iterable[str] = ("score", "constraint_score"), delta: float = 0.0) -> DataFrame:
    """graph_id, passed, failures: the score's threshold and the ratchet together."""
    checks = policy.ratchet(current, baseline, watched, delta)
    if least is not None:
        fixed = current.select("graph_id", F.lit("score").alias("metric"), F.col("score").alias("value"), F.lit(float(least)).alias("baseline"), (F.col("score") >= least).alias("passed"))
        checks = checks.union(fixed)
    message = F.when(~F.col("passed"), F.concat_ws(" ", "metric", F.lit("is"), F.col("value").cast("string"), F.lit("below"), F.col("baseline").cast("string")))
    return checks.groupBy("graph_id").agg(F.min("passed").alias("passed"), F.array_sort(F.collect_list(message)).alias("failures"))


def to_markdown(df: DataFrame, digits: int = 4, rows: int = 1000) -> str:
    """A small result as a Markdown table; nulls are n/a."""
    show = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in df.limit(rows).collect())])


def write_report(df: DataFrame, path: str) -> None:
    """A small result as a JSON list in one file on the driver."""
    Path(path).write_text(json.dumps([json.loads(x[0]) for x in df.select(F.to_json(F.struct("*"))).collect()], indent=2))


def discovery(g: gr.Graph, min_confidence: float = 0.5, min_size: int = 3, membership: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters (graph_id, label, size), explained rules, and a summary row per graph.

    membership: graph_id, id, label of groups that are known already; without
    it they are found, and written once, as all three tables read them.
    """
    members = materialize(policy.cluster_members(g, min_size)) if membership is None else membership
    clusters = members.groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("size"))
    rules = policy.explain_rules(policy.cross_edges(g, members), members, min_confidence)
    parts = (
        g.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes")),
        gr.dominant_internal(g).groupBy("graph_id").agg(F.count(F.lit(1)).alias("internal_nodes")),
        g.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges")),
        clusters.groupBy("graph_id").agg(F.count(F.lit(1)).alias("clusters")),
        rules.groupBy("graph_id").agg(F.count(F.lit(1)).alias("rules"), F.count(F.when(F.col("confidence") >= SURE, 1)).alias("sure_rules")),
    )
    summary = g.graphs()
    for part in parts:
        summary = summary.join(part, "graph_id", "left")
    return clusters, rules, summary.fillna(0)


def rules_of(proposed: DataFrame, least: float = SURE) -> list[Mapping[str, str]]:
    """Proposed rules of enough confidence in the form that ``policy.rules_table`` takes."""
    rows = proposed.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "rule_from", "rule_to").collect()
    return [{"name": f"{r['rule_from']} to {r['rule_to']}", "type": "forbidden", "from": r["rule_from"], "to": r["rule_to"]} for r in rows]
