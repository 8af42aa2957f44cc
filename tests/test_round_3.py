"""Findings of the third round: whole results at any size of a graph."""

import random

import pytest

from plumbline.operators import graph as gr
from plumbline.operators import traversal as tr


def some_edges(nodes, n, seed):
    rnd = random.Random(seed)
    return sorted({(f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}") for _ in range(n)})


def reach_of(edges):
    near = {}
    for s, t in edges:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set())
    out = {}
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[x] = seen
    return out


def test_ripple_counts_every_node_of_a_large_graph(spark):
    """2,500 nodes and more in paths of 5, 50 and 500 and a ring of 300: any 500 of them, scaled up, miss the sum."""
    edges, expected = [], 0
    for k, (paths, length) in enumerate(((100, 5), (20, 50), (2, 500))):
        for p in range(paths):
            edges += [(f"{k}.{p}.{i}", f"{k}.{p}.{i + 1}") for i in range(length - 1)]
            expected += length * (length + 1) // 2
    edges += [(f"r{i}", f"r{(i + 1) % 300}") for i in range(300)]
    expected += 300 * 300
    g = gr.Graph.of_edges(spark.createDataFrame(edges, "src string, tgt string"))
    assert tr.cumulative_dependency(g).first()["ccd_raw"] == expected


@pytest.mark.parametrize(("nodes", "n", "part"), [(60, 70, 10), (60, 90, 1000), (40, 300, 1000)])
def test_reduced_edges_reach_the_same(spark, nodes, n, part):
    """Two graphs with the same names, sparse and dense, in parts of several sizes; loops are no matter."""
    edges = {g: some_edges(nodes, n, seed) for seed, g in enumerate("gh")}
    rows = spark.createDataFrame([(g, s, t) for g, es in edges.items() for s, t in es], "graph_id string not null, src string not null, tgt string not null").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # several batches, also after a reduction
    found = {g: [] for g in edges}
    for g, s, t in tr.reduced(rows, 0, part).collect():
        found[g].append((s, t))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g, es in edges.items():
        assert reach_of(found[g]) == reach_of([(s, t) for s, t in es if s != t])
    if n == 300:
        assert sum(map(len, found.values())) < 200


def test_large_dense_graphs_need_no_joins(spark, monkeypatch):
    """Edges that are too many for a task are reduced first; sources that reach none stay out."""
    monkeypatch.setattr(tr, "_cycles_by_joins", None)
    monkeypatch.setattr(tr, "_reach_by_joins", None)
    edges = [e for e in some_edges(60, 900, 5) if e[0] != e[1]] + [("x", "n1"), ("n2", "y"), ("y", "z")]
    g = gr.Graph.of_edges(spark.createDataFrame(edges, "src string, tgt string"))
    reach = reach_of(edges)
    assert {r["id"]: r["reached"] for r in tr.reach_counts(g.edges, g.scope(), 200).collect()} == {x: len(r) - 1 for x, r in reach.items() if len(r) > 1}
    assert {(r["id"], r["cycle"], r["size"]) for r in tr.cycles(g.edges, 200).collect()} == {(x, min(c), len(c)) for x in reach for c in [{y for y in reach[x] if x in reach[y]}] if len(c) > 1}
