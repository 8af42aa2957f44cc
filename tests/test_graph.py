"""Graph metrics against worked examples and the registry's SQL."""

import fnmatch
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline import registry
from plumbline.functions import names
from plumbline.operators import graph as gr
from plumbline.operators import mutate, policy
from plumbline.operators import traversal as tr
from plumbline.operators.statistics import dose_response, same_rows
from plumbline.plans import engine
from plumbline.sources import tables

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def graph(spark, edges, nodes=(), internal=()):
    e = spark.createDataFrame(list(edges), "src string, tgt string")
    n = spark.createDataFrame([(x, x in internal) for x in {*nodes, *internal}], "id string, internal boolean")
    return gr.Graph.of_edges(e, n)


def value(df, column):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][column]


def chain(n):
    return [(f"m{i}", f"m{i + 1}") for i in range(n - 1)]


def ring(n):
    return [(f"m{i}", f"m{(i + 1) % n}") for i in range(n)]


def coupled(n):
    return [(f"m{i}", f"m{j}") for i in range(n) for j in range(n) if i != j]


@pytest.mark.parametrize("small", [tr.SMALL, 0])
@pytest.mark.parametrize(
    ("edges", "internal", "expected"),
    [
        ([("a", "b"), ("b", "c"), ("a", "c")], (), 1.0), ([("a", "b"), ("b", "c"), ("c", "a")], (), 0.0), ([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], (), 0.25),
        ([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], (), 0.5), ([*chain(30), ("m5", "m3")], (), 0.9), ([("app.mod", "x.a"), ("x.a", "x.b"), ("x.b", "x.a")], ("app.mod",), 1.0),
        ([("app.a", "app.b"), ("app.b", "app.a"), ("app.a", "os")], ("app.a", "app.b"), 0.0),
    ],
)
def test_acyclicity(spark, edges, internal, expected, small):
    assert value(tr.acyclicity(graph(spark, edges, internal=internal), small), "acyclicity") == pytest.approx(expected)


def test_long_paths_and_cycles_by_joins(spark):
    """A path of 1,000 nodes into a cycle of 1,000, from which another path goes out, beside a path of its own."""
    name = lambda kind, i: f"{kind}{i:04d}"
    path = lambda kind, n: [(name(kind, i), name(kind, i + 1)) for i in range(n - 1)]
    edges = [*path("a", 1000), (name("a", 999), name("c", 0)), *path("c", 1000), (name("c", 999), name("c", 0)), (name("c", 500), name("d", 0)), *path("d", 300), *path("z", 1000)]
    got = tr.cycles(graph(spark, edges).edges, small=0).collect()
    assert {r["id"] for r in got} == {name("c", i) for i in range(1000)} and {(r["cycle"], r["size"]) for r in got} == {("c0000", 1000)}


@pytest.mark.parametrize("seed", (1, 2))
def test_cycles_by_joins_equal_those_in_memory(spark, seed):
    rng = random.Random(seed)
    edges = graph(spark, {(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(150)}).edges
    assert same_rows(tr.cycles(edges, small=0), tr.cycles(edges))


def test_no_edges(spark):
    g = graph(spark, [], ["a", "b", "c"])
    assert value(tr.acyclicity(g), "acyclicity") == 1.0 and value(gr.stability(g), "stability") == 0.0
    assert value(engine.modularity(g), "modularity") == 1.0 and value(gr.boundary_crossing(g), "boundary_crossing") == 0.5
    assert gr.stability(graph(spark, [])).count() == 0


def test_stability(spark):
    layers = [(f"leaf{i}", f"core{j}") for i in range(10) for j in range(10)]
    star = [(f"leaf{i}", "hub") for i in range(20)]
    users = [(f"p{i}.main.m{j}", "lib.base.x") for i in range(10) for j in range(4)]  # ten packages of instability 1, one of 0
    s = lambda e: value(gr.stability(graph(spark, e)), "stability")
    assert s(layers) > 0.9 and s(star) > s(ring(20)) and s(coupled(8)) == pytest.approx(0.0, abs=1e-6) and s(users) == pytest.approx(10 / 11 * 1 / 11 / 0.25)
    assert value(gr.instability_variance(graph(spark, [("leaf", "root")])), "instability_variance") > 0


def test_boundary_crossing(spark):
    b = lambda e: value(gr.boundary_crossing(graph(spark, e)), "boundary_crossing")
    assert b([("a.b.c", "a.b.d")]) == 1.0 and b([("a.b.c", "x.y.z")]) == 0.0 and b([("a.b.c", "a.b.d"), ("a.b.c", "x.y.z")]) == 0.5


def test_modularity_and_communities(spark):
    two = [(f"a{i:02}", f"a{i + 1:02}") for i in range(14)] + [(f"b{i:02}", f"b{i + 1:02}") for i in range(14)]
    m = lambda e: value(engine.modularity(graph(spark, e)), "modularity")
    assert m(chain(5)) == 0.5 and m(coupled(15)) < 0.3 and m(two) > 0.5
    found = {r["id"]: r["community"] for r in tr.communities(graph(spark, two).edges).collect()}
    assert all(found[x][0] == x[0] for x in found)
    assert same_rows(tr.communities(graph(spark, two).edges), tr.communities(graph(spark, two[::-1]).edges))


@pytest.mark.parametrize("small", [tr.SMALL, 0])
def test_ripple(spark, small):
    r = tr.cumulative_dependency(graph(spark, chain(4)), small=small).first()
    assert (r["ccd_raw"], r["avg_reachable"]) == (10, 2.5) and r["ccd_norm"] == pytest.approx(10 / (4 * math.log2(5)))
    assert tr.cumulative_dependency(graph(spark, [], ["a"]), small=small).first()["ccd_raw"] == 0


def test_sampled_ripple_scales_up(spark):
    r = tr.cumulative_dependency(graph(spark, ring(60)), above=50, sample=10).first()
    assert r["ccd_raw"] == 3600


def test_similarity(spark):
    rows = {(r["src"], r["tgt"]): r["similarity"] for r in gr.edge_similarity(graph(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")])).collect()}
    assert rows[("a", "b")] == pytest.approx(1 / 3) and rows[("c", "d")] == 0.0
    pairs = {(r["a"], r["b"]): r["similarity"] for r in gr.profile_similarity(graph(spark, [("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")])).collect()}
    assert pairs == {("a", "b"): 0.5}


def test_modules(spark):
    g = graph(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")])
    rows = {r["id"]: r for r in gr.module_metrics(g, tr.cycles(g.inner_edges())).collect()}
    assert (rows["c"]["fan_in"], rows["c"]["fan_out"], rows["c"]["in_cycle"]) == (2, 1, False) and rows["a"]["in_cycle"]
    assert gr.top_modules(gr.module_metrics(g, tr.cycles(g.inner_edges())), 1).first()["id"] == "b"


@pytest.mark.parametrize(
    ("methods", "expected"),
    [([(None, None)], 1), ([("a", ["x"]), ("b", ["x"])], 1), ([("a", ["x"]), ("b", ["y"])], 2), ([("a", ["x"]), ("b", ["x", "y"]), ("c", ["y"])], 1), ([("a", ["x"]), ("b", ["y"]), ("c", [])], 3), ([("a", ["x"]), ("a", ["y"])], 1)],
)
def test_lcom4(spark, methods, expected):
    df = spark.createDataFrame([("g", "C", m, a) for m, a in methods], "graph_id string, class string, method string, attrs array<string>")
    assert value(tr.lcom4(df), "lcom4") == expected
    if methods[0] == ("a", ["x"]) and methods[-1] == ("a", ["y"]):
        assert value(tr.lcom4(df, merge_names=False), "lcom4") == 2


@pytest.mark.parametrize(("counts", "expected"), [([1, 1, 1], 1.0), ([5], 0.0), ([1, 3], 0.75), ([10], 0.0)])
def test_cohesion(spark, counts, expected):
    assert value(tr.cohesion(spark.createDataFrame([("g", c) for c in counts], "graph_id string, lcom4 long")), "cohesion") == expected


PAY = [("payments.service", "payments.model"), ("payments.api", "payments.service"), ("payments.api", "payments.model")]
TWO = [*PAY, *[(a.replace("payments", "users"), b.replace("payments", "users")) for a, b in PAY], ("payments.service", "users.model")]


def test_discovery(spark):
    rules = {(r["rule_from"], r["rule_to"]): r["confidence"] for r in policy.discover(graph(spark, TWO)).collect()}
    assert rules == {("users/*", "payments/*"): 0.85}
    apart = [("alpha.a1", "alpha.a2"), ("alpha.a2", "alpha.a3"), ("beta.b1", "beta.b2"), ("beta.b2", "beta.b3")]
    assert {(r["rule_from"], r["rule_to"]) for r in policy.discover(graph(spark, apart)).collect()} == {("alpha/*", "beta/*"), ("beta/*", "alpha/*")}
    assert {r["name"] for r in engine.rules_of(policy.discover(graph(spark, TWO))) if r["from"] == "users/*"} == {"users/* to payments/*"}


def test_directions(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (0, 3), (5, 4), (95, 5)], "a long, b long")
    got = [tuple(r) for r in df.select(policy.direction(F.col("a"), F.col("b")).alias("d")).select("d.direction", "d.confidence").collect()]
    assert got == [("isolated", 0.9), ("a_to_b", 0.85), ("b_to_a", 0.85), ("bidirectional", 0.3), ("a_to_b", 0.6)]


def test_constraints(spark):
    edges = graph(spark, [("api.x", "core.y"), ("api.x", "db.z"), ("ui.a", "core.y")]).edges
    rules = policy.rules_table(spark, [{"name": "n", "from": "api/*", "to": "core/*"}, {"from": "*", "to": "[!c]*"}, {"type": "allowed", "from": "*", "to": "*"}])
    found = policy.violations(edges, rules)
    assert sorted((r["src"], r["tgt"], r["pattern_from"]) for r in found.collect()) == [("api.x", "core.y", "api/*"), ("api.x", "db.z", "*")]
    assert value(policy.constraint_score(edges, found), "constraint_score") == pytest.approx(1 / 3)
    assert names.glob_regex("a/*") and names.literal_root("*/x") is None and names.literal_root("a/b") == "a"


def test_constraints_equal_brute_force(spark):
    edges = tables.synthetic_graph(spark, 60, 300)
    rules = tables.synthetic_rules(25)
    path = lambda x: x.replace(".", "/")
    expected = sorted((e["src"], e["tgt"], r["name"]) for e in edges.collect() for r in rules if fnmatch.fnmatchcase(path(e["src"]), r["from"]) and fnmatch.fnmatchcase(path(e["tgt"]), r["to"]))
    assert expected and sorted((r["src"], r["tgt"], r["name"]) for r in policy.violations(edges, policy.rules_table(spark, rules)).collect()) == expected


def test_ratchet_and_gate(spark):
    now = spark.createDataFrame([("g", 0.7, 0.5), ("h", 0.9, None)], "graph_id string, score double, constraint_score double")
    before = spark.createDataFrame([("g", 0.75, 0.4)], "graph_id string, score double, constraint_score double")
    passed = {(r["graph_id"], r["metric"]): r["passed"] for r in policy.ratchet(now, before, ["score", "constraint_score"], 0.01).collect()}
    assert passed == {("g", "score"): False, ("g", "constraint_score"): True, ("h", "score"): True, ("h", "constraint_score"): True}
    gates = {r["graph_id"]: r for r in engine.gate(now, 0.8, before, ["score"]).collect()}
    assert not gates["g"]["passed"] and len(gates["g"]["failures"]) == 2 and gates["h"]["passed"]


def test_mutations_are_new_and_repeatable(spark):
    g = graph(spark, [(f"a.x{i}", f"b.y{i % 5}") for i in range(20)] + [(f"b.y{i}", f"c.z{i}") for i in range(5)])
    back = mutate.inject_cycles(g, 1.0, 1)
    assert back.count() > 0 and back.join(g.edges, ["graph_id", "src", "tgt"]).count() == 0
    assert value(tr.acyclicity(mutate.mutated(g, "cycles", 1.0, 1)), "acyclicity") < 1.0
    for kind in mutate.TYPES:
        assert same_rows(mutate.mutated(g, kind, 0.5, 3).edges, mutate.mutated(g, kind, 0.5, 3).edges)
    study = mutate.study(g, ("cycles", "hubs"), (0.1, 1.0), (1,))
    assert tr.acyclicity(study).count() == 4
    doses = spark.createDataFrame([("m", float(d), 1.0 - d / 10) for d in range(8)] + [("n", float(d), 0.5) for d in range(8)], "kind string, dose double, score double")
    assert {r["kind"]: r["passed"] for r in dose_response(doses, ["kind"], "dose", "score").collect()} == {"m": True, "n": False}


def test_registry_equals_sql(spark, data):
    """Every query with SQL, on the small tables."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    clean = lambda rows: sorted((tuple(0.0 if v == 0 else v for v in r) for r in rows), key=repr)
    slow = {"acyclicity_by_joins", "cumulative_dependency_by_joins"}
    for name, sql in registry.oracle_sql().items():
        if name in slow:
            continue
        df = registry.queries()[name](spark, data)
        columns = sorted(df.columns)
        expected = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert clean(df.select(*columns).collect()) == clean(expected), name
