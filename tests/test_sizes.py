"""What only larger tables showed: results against brute force with small blocks, and rounding against SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph as gr
from plumbline.operators import statistics as st
from plumbline.operators import traversal as tr
from plumbline.plans import fixtures as fx


def random_edges(nodes, n, seed, loops=False):
    rnd = random.Random(seed)
    found = set()
    while len(found) < n:
        e = (f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}")
        if loops or e[0] != e[1]:
            found.add(e)
    return sorted(found)


def of(spark, edges):
    return gr.Graph.of_edges(spark.createDataFrame(edges, "src string, tgt string"))


def test_halves_round_as_in_sql(spark):
    numbers = [0.6596204999999999, 0.6596205, 0.1234565, -0.1234565, 1.0000005, 0.5]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select(fx.six_digits(F.col("x"))).collect()
    assert [r[0] for r in rows] == [duckdb.sql(f"SELECT round({x!r}::DOUBLE, 6)").fetchall()[0][0] for x in numbers]


def test_sobel_tail_is_exact(spark):
    found = spark.createDataFrame([(60000, 0.0135, 0.999, 0.0145, 0.0135, 0.93, z) for z in (0.5, 1.7, 3.305626)], "n long, r_a double, r_b double, r_c double, indirect double, share double, sobel_z double")
    for r in st.mediation_verdict(found).collect():
        assert r["sobel_p"] == pytest.approx(math.erfc(r["sobel_z"] / math.sqrt(2)), abs=1e-10)


@pytest.mark.parametrize("block", [None, 40])
def test_similarities_in_blocks(spark, block):
    """Loops, both directions, a hub and names that sort unlike their numbers."""
    edges = sorted({*random_edges(30, 150, 1, loops=True), *((f"n{i}", "n3") for i in range(30))})
    g = of(spark, edges)
    near, out = {}, {}
    for s, t in edges:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)
        out.setdefault(s, set()).add(t)
    alike = lambda a, b: (len(a & b), round(len(a & b) / len(a | b), 9))
    found = sorted((r["src"], r["tgt"], r["shared"], round(r["similarity"], 9)) for r in gr.edge_similarity(g, block).collect())
    assert found == [(s, t, *alike(near[s], near[t])) for s, t in edges]
    pairs = sorted((r["a"], r["b"], r["shared"], round(r["similarity"], 9)) for r in gr.profile_similarity(g, block).collect())
    assert pairs == sorted((a, b, *alike(out[a], out[b])) for a in out for b in out if a < b and out[a] & out[b])


def test_similarities_stay_within_a_graph(spark):
    e = spark.createDataFrame([(g, s, t) for g in ("g", "h") for s, t in (("a", "x"), ("b", "x"), ("a", "b"))], "graph_id string, src string, tgt string")
    g = gr.Graph.of_edges(e)
    assert sorted(tuple(r) for r in gr.profile_similarity(g).collect()) == [("g", "a", "b", 1, 0.5), ("h", "a", "b", 1, 0.5)]
    assert {(r["graph_id"], r["src"], r["tgt"]): r["shared"] for r in gr.edge_similarity(g, 2).collect()} == {(x, s, t): 1 for x in "gh" for s, t in (("a", "x"), ("b", "x"), ("a", "b"))}


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_by_joins_over_condensed_cycles(spark, seed, monkeypatch):
    """Sparse graphs of cycles and paths; more than 64 sources, so several words; no row for each source and node."""
    g = of(spark, random_edges(150, 190, seed, loops=True))
    rows = lambda small: sorted(tuple(r) for r in tr.reach_counts(g.edges, g.scope(), small).collect())
    expected = rows(tr.SMALL)
    monkeypatch.setattr(tr, "_cycles_by_joins", lambda edges: tr.cycles(edges))
    assert len(expected) > 64 and rows(0) == expected


def test_local_moving_of_integers():
    """Two cliques with one edge between them, and a pair apart."""
    near = [[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2, 4], [3, 5, 6], [4, 6], [4, 5], [8], [7]]
    at = [0]
    for x in near:
        at.append(at[-1] + len(x))
    assert tr.local_moving(np.array(at), np.array(sum(near, []), np.int32)).tolist() == [0, 0, 0, 0, 4, 4, 4, 7, 7]


def test_communities_keep_no_names_of_edges(spark, monkeypatch):
    """The task gets a row of integers for each node, not a row of names for each edge; several graphs in one task."""
    monkeypatch.setattr(tr, "_per_graph", None)
    e = spark.createDataFrame([(g, f"{g}{s}", f"{g}{t}") for g in ("g", "h") for s, t in (("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("z", "z"))], "graph_id string, src string, tgt string")
    found = {(r["graph_id"], r["id"]): r["community"] for r in tr.communities(e).collect()}
    assert found == {(g, f"{g}{x}"): f"{g}{c}" for g in ("g", "h") for x, c in (("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"))}
