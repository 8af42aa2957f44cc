"""Findings of the second round on graphs."""

import json
import random

import pytest

from plumbline.operators import graph as gr
from plumbline.sources import tables


def test_profiles_compute_their_edges_once(spark):
    """Edges that come from a long plan are written once; before, each step made them and their shuffle files again."""
    seen = spark.sparkContext.accumulator(0)
    pairs = [(f"n{i}", f"n{j}") for i in range(20) for j in range(20, 20 + i % 5 + 1)]

    def count(r):
        seen.add(1)
        return r

    edges = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2).map(count), "src string, tgt string")
    out = {}
    for s, t in pairs:
        out.setdefault(s, set()).add(t)
    found = {(r["a"], r["b"]): r["shared"] for r in gr.profile_similarity(gr.Graph.of_edges(edges)).collect()}
    assert found == {(a, b): len(out[a] & out[b]) for a in out for b in out if a < b}
    assert seen.value == len(pairs)


def test_graph_documents_in_pieces(spark, tmp_path, monkeypatch):
    """One document without line ends, a pretty one with odd names, and a graph in parts are read alike, whatever the pieces."""
    odd = ["a],[", 'q"],', "x},{", "{y", "back\\", "ü ,", "]", ""]
    rnd = random.Random(3)
    edges = sorted({(rnd.choice(odd) + str(i % 40), rnd.choice(odd) + "t") for i in range(400)})
    document = {"other": {"edges": [["no", "no"]]}, "nodes": [{"id": s, "internal": True} for s, _ in edges[:20]] + ["alone"], "n": 12, "edges": [list(e) for e in edges], "classes_lcom4": list(range(30))}
    (tmp_path / "plain.json").write_text(json.dumps(document, ensure_ascii=False, separators=(",", ":")))
    (tmp_path / "pretty.json").write_text(json.dumps(document, indent=1))
    for text in (f.read_text() for f in sorted(tmp_path.iterdir())):
        monkeypatch.setattr(tables, "PIECE", rnd.randrange(1, 300))
        cuts = sorted({0, len(text), *rnd.sample(range(len(text)), 100)})
        found = list(tables._documents(text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)))
        assert {k: [m for key, ms in found if key == k for m in ms] for k in document} == {k: v if isinstance(v, list) else [v] for k, v in document.items()}
    g, lcom = tables.read_graph_json(spark, str(tmp_path))
    for name in ("plain", "pretty"):
        assert sorted((r["src"], r["tgt"]) for r in g.edges.where(f"graph_id = '{name}'").collect()) == edges
        marked = {r["id"] for r in g.nodes.where(f"graph_id = '{name}' and internal").collect()}
        assert marked == {s for s, _ in edges[:20]} and g.nodes.where(f"graph_id = '{name}' and id = 'alone'").count() == 1
        assert sorted(r["lcom4"] for r in lcom.where(f"graph_id = '{name}'").collect()) == list(range(30))
    again = tables.read_graph_json(spark, tables.write_graph_json(g, f"file://{tmp_path}/parts"))[0]
    for one, other in ((g.edges, again.edges), (g.nodes, again.nodes)):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    whole = {r["graph_id"]: json.loads(r["json"]) for r in tables.graph_json(g).collect()}
    assert [tuple(e) for e in whole["plain"]["edges"]] == edges and whole["plain"]["nodes"] == whole["pretty"]["nodes"]


def test_documents_are_held_in_pieces(monkeypatch):
    """A document is parsed as it comes: before its last piece, its first members are out."""
    monkeypatch.setattr(tables, "PIECE", 100)
    taken = []

    def pieces():
        yield '{"edges":['
        for i in range(1000):
            taken.append(i)
            yield f'["a{i}","b{i}"],'
        yield '["x","y"]]},'

    found = tables._documents(pieces())
    assert [next(found) for _ in range(2)][1][0] == "edges" and len(taken) < 20
    assert sum(len(m) for _, m in found) > 900


def test_cut_documents_are_errors():
    for text in ('{"edges":[["a","b"],["c",', '{"edges":[["a","b"]],', '{"nodes"', "5,"):
        with pytest.raises(ValueError):
            list(tables._documents(iter([text])))
