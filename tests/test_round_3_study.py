"""Findings of the third round on mutation studies."""

from plumbline.operators import graph as gr
from plumbline.operators import mutate


def test_study_writes_the_graph_once(spark, monkeypatch):
    """Each combination has the graph's edges and its own, each once, though only new edges are written for it."""
    pairs = sorted({(f"p{i % 7}.n{i % 20}", f"p{(i * 3 + 1) % 7}.n{(i * 11 + 1) % 20}") for i in range(90)})
    g = gr.Graph.of_edges(spark.createDataFrame([e for e in pairs if e[0] != e[1]], "src string, tgt string"))
    written = []
    plain = mutate.materialize
    monkeypatch.setattr(mutate, "materialize", lambda df: written.append((out := plain(df)).count()) or out)
    found = mutate.study(g, ("hubs", "cycles"), (0.3,), (1,))
    rows = found.edges.collect()
    n = g.edges.count()
    assert sum(k >= n for k in written) <= 3, written  # nodes, and the pairs of packages with their order
    for kind in ("hubs", "cycles"):
        one = mutate.mutated(g, kind, 0.3, 1)
        got = sorted((r["src"], r["tgt"]) for r in rows if r["graph_id"] == f"g/{kind}/0.3/1")
        assert got == sorted({(r["src"], r["tgt"]) for r in one.edges.collect()})
