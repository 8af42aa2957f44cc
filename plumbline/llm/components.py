"""Connected components by alternating stars, with the edges kept in the shared folder between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within blocks of a partition, replace edges by one from each node to its block's smallest."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def rows() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], names=["u", "v"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x in (a, b):
                parent.setdefault(x, x)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:
            yield rows()
            parent.clear()
    if parent:
        yield rows()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. Edges are (u, v) with u > v.

    Large: each node links its larger neighbours to the smallest of its
    neighbours and itself. Small: it links its smaller neighbours and itself.
    The smallest are written before the join, whose sides are then plain
    shuffles, so that the adaptive join can split a hub.
    """
    if large:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
        joined = edges.join(least, "u")
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (its component's smallest node) for every node but the roots.

    edges: two columns of one ordered type, in any direction; loops and
    repeated edges don't matter. Each round needs shuffles of the edges only;
    a hub's edges are reduced by key or split by the adaptive join.
    """
    a, b = edges.columns
    kind = edges.schema[a].dataType.simpleString()
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    edges = materialize(edges.mapInArrow(_contract, f"u {kind}, v {kind}").distinct())
    state = None
    for _ in range(most_rounds):
        edges = materialize(_stars(materialize(_stars(edges, True)), False))
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.toDF("node", "root")
        state = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
