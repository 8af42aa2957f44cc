"""Sources, parsers, scores, statistics, history, test suites, streaming, reports."""

import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import names, pvalues, scores
from plumbline.operators import history, statistics
from plumbline.operators.test_suite import test_quality as quality
from plumbline.plans import engine
from plumbline.plans.ordering import running_sum
from plumbline.sources import code, tables
from plumbline.streaming import ratchet

PYTHON = '''
import os, json as j
from a.b import c
from . import near
class Base(ABC):
    x = 1
    def one(self): return self.x + self.y
    @abstractmethod
    def two(self): self.z = 1
def f():
    import inner
class Empty: pass
'''
JAVA = '''package org.app; // import no.no;
import java.util.List; import static org.x.Y.*;
/* class Not {} */
public abstract class Shop<T> extends Base {
  private String s = "class Fake {";
  Shop(int a) { this.a = a; if (a > 1) { this.b = 2; } }
  public int get() throws E { return this.a; }
}
interface Door { void open(); }
'''
GO = 'package main\nimport "fmt"\nimport (\n  x "net/http"\n  "os"\n)\ntype Car struct { a int }\ntype Door interface {}\n'


def test_parsers():
    imports, classes = code.python_rows(PYTHON)
    assert imports == ["a.b", "inner", "json", "os"]
    assert classes == [{"name": "Base", "is_abstract": True, "methods": [{"name": "one", "attrs": ["x", "y"]}, {"name": "two", "attrs": ["z"]}]}, {"name": "Empty", "is_abstract": False, "methods": []}]
    imports, classes = code.java_rows(JAVA)
    assert imports == ["java.util.List", "org.x.Y"] or imports == ["java.util.List"]
    assert [(c["name"], c["is_abstract"]) for c in classes] == [("Shop", True), ("Door", True)]
    assert classes[0]["methods"] == [{"name": "Shop", "attrs": ["a", "b"]}, {"name": "get", "attrs": ["a"]}]
    imports, classes = code.go_rows(GO)
    assert imports == ["fmt", "net/http", "os"] and [c["name"] for c in classes] == ["Car", "Door"]
    assert code.python_rows("def (") == ([], [])


def files(spark, rows):
    return spark.createDataFrame([("g", p, t) for p, t in rows], "graph_id string, path string, text string")


def test_scan(spark):
    f = files(spark, [("src/app/__init__.py", ""), ("src/app/a.py", "import b\nimport os\nclass A:\n  def m(self): self.x\n  def n(self): self.y"), ("src/app/b.py", "import a"), ("src/app/.hid/c.py", "import b"), ("README.md", "x")])
    g, lcom, languages = engine.scan(f)
    assert sorted((r["src"], r["tgt"]) for r in g.edges.collect()) == [("a", "b"), ("a", "os"), ("b", "a")]
    assert {r["id"]: r["internal"] for r in g.nodes.collect()} == {"a": True, "b": True, "os": False}
    assert [r["lcom4"] for r in lcom.collect()] == [2] and languages.first()["language"] == "Python"
    row = engine.score_files(f).first()
    assert row["acyclicity"] == 0.0 and row["fingerprint"] == "CYCLIC" and row["nodes"] == 3
    assert code.source_root(f).first()["root"] == "src/app"


def test_file_helpers(spark):
    f = files(spark, [("a/test/X.java", ""), ("m/A.java", JAVA), ("m/b.go", GO), ("m/c.py", "")])
    assert {r["path"] for r in code.keep_sources(f).collect()} == {"m/A.java", "m/b.go", "m/c.py"}
    assert {r["module"] for r in code.parse(f.where("path = 'm/A.java'")).collect()} == {"org.app.A"}
    assert code.within_depth(f, 2).count() == 3 and code.common_language(f).first()["language"] == "Java"
    parsed = code.parse(f.where("path = 'm/c.py'"))
    assert {(r["alias"], r["path"]) for r in code.file_index(parsed).collect()} == {("m.c", "m/c.py"), ("c", "m/c.py")}
    assert f.select(code.lines_of_code(F.lit("a\n\n # c\nb"))).first()[0] == 2


def test_read_files(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "a.py").write_text("import b")
    (root / "pkg" / "bad.py").write_bytes(b"\xff\xfe")
    (root / "pkg" / "note.txt").write_text("x")
    assert [tuple(r) for r in code.read_files(spark, str(root)).collect()] == [("g", "pkg/a.py", "import b")]


def test_tables(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"nodes": [{"id": "a.b", "internal": True}, "x"], "edges": [["a.b", "a.c"]], "classes_lcom4": [1, 3]}))
    g, lcom = tables.read_graph_json(spark, str(tmp_path / "one.json"))
    assert {tuple(r) for r in g.nodes.collect()} == {("one", "a.b", True), ("one", "x", False), ("one", "a.c", False)} and lcom.count() == 2
    assert json.loads(tables.graph_json(g).first()["json"])["edges"] == [["a.b", "a.c"]]
    (tmp_path / "res.json").write_text(json.dumps({"results": [{"name": "p", "url": "u", "agq": {"modularity": 0.5, "agq_score": 0.6, "nodes": 3, "language": "Go"}, "churn": {"n_files": 2}, "runtime_ms": 4.0}]}))
    assert tables.read_results(spark, str(tmp_path / "res.json")).select("name", "agq_score", "n_files").first() == ("p", 0.6, 2)
    (tmp_path / "repo.log").write_text("@s1\t100\tfix: a\tb\n\nsrc/a.py\nREADME.md\n@s2\t200\tadd\nsrc/a.py\n")
    log = tables.read_log(spark, str(tmp_path / "repo.log"))
    assert sorted((r["repo"], r["sha"], r["subject"], r["path"]) for r in log.collect()) == [("repo", "s1", "fix: a\tb", "README.md"), ("repo", "s1", "fix: a\tb", "src/a.py"), ("repo", "s2", "add", "src/a.py")]
    graph = tables.synthetic_graph(spark, 100, 500)
    assert graph.count() == 500 and graph.where("src = tgt").count() == 0 and len(tables.synthetic_rules(10)) == 10
    assert tables.parse_cases("10:20:3,1:2:3") == [(10, 20, 3), (1, 2, 3)]


@pytest.mark.parametrize(
    ("metrics", "name"),
    [((0.5, 1, 0.95, 1), "CLEAN"), ((0.6, 1, 0.8, 0.7), "LAYERED"), ((0.6, 0.85, 0.4, 0.2), "TANGLED"), ((0.6, 0.85, 0.4, 0.6), "CYCLIC"), ((0.6, 1, 0.5, 0.3), "LOW_COHESION"), ((0.5, 1, 0.2, 0.6), "FLAT"), ((0.5, 1, 0.55, 0.55), "MODERATE")],
)
def test_fingerprint(spark, metrics, name):
    assert spark.range(1).select(scores.fingerprint(*[F.lit(float(x)) for x in metrics])).first()[0] == name


def test_scores(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    z = lambda s, x: one(scores.language_z(F.lit(s), F.lit(x)))
    assert z(0.7494, "Python") == pytest.approx(0) and z(0.7, "Rust") is None and z(0.75, "Java") > z(0.75, "Go")
    assert one(scores.language_percentile(F.lit(0.85), F.lit("Python"))) > 90
    assert one(scores.normal_cdf(F.lit(1.0))) == pytest.approx(0.5 * math.erfc(-1 / math.sqrt(2)), abs=1e-6)
    for a, level in ((1.0, "NONE"), (0.995, "LOW"), (0.97, "MEDIUM"), (0.90, "HIGH"), (0.70, "CRITICAL")):
        assert one(scores.cycle_severity(F.lit(a)))["severity_level"] == level
    risk = lambda *m: one(scores.churn_risk(*[F.lit(float(x)) for x in m]))
    assert risk(1, 1, 0.8)["churn_risk_level"] == "LOW" and risk(0.7, 0.2, 0.3)["churn_risk_score"] > 0.4
    size = lambda n: one(scores.size_adjusted(F.lit(0.75), F.lit(n)))
    assert size(500) == pytest.approx(0.75) and size(50) > 0.75 > size(5000) and size(5) == 0.75
    c = lambda w: one(scores.composite([F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)], w))
    assert c((0.25,) * 4) == pytest.approx(0.25) and c((0, 1, 0, 0)) == pytest.approx(0.2) and c((0, 0, 0, 0)) == pytest.approx(0.25) and c((0, 73, 5, 17)) == pytest.approx(c((0, 0.73, 0.05, 0.17)))
    assert one(scores.finite(F.lit("nan"))) is None and one(scores.rating_letter(F.lit(2.5))) == "B" and one(scores.per_kloc(F.lit(5), F.lit(0))) is None
    assert one(names.common_prefix(F.lit("a.b.c"), F.lit("a.b.d"))) == "a.b" and one(names.file_package(F.lit("x.py"))) == "__root__"


def test_history(spark):
    rows = [("r", f"c{i}", "x", "src/hot.py") for i in range(10)] + [("r", "c1", "x", "src/a.py"), ("r", "c2", "x", "lib/b.py"), ("r", "c3", "x", "tests/test_a.py"), ("r", "c4", "x", "README.md")]
    df = spark.createDataFrame(rows, "repo string, sha string, subject string, path string")
    c = history.churn(history.touches(df)).first()
    assert (c["n_files"], c["mean_churn"], c["max_churn"]) == (3, 4.0, 10) and c["hotspot_ratio"] > 0 and c["gini"] > 0
    even = spark.createDataFrame([("r", 2), ("r", 2)], "repo string, n long")
    assert history.gini(even, "repo", "n").first()["gini"] == 0.0
    entropy = history.cochange(df.where("path <> 'README.md' and path not like 'tests%'")).first()
    assert entropy["n_commits"] == 2 and entropy["n_files"] == 3 and entropy["entropy"] == pytest.approx(1.5)
    fixes = spark.createDataFrame([("r", f"f{i}", "Fix bug", f"src/p/m{j}.py") for i in range(3) for j in range(i + 1)], "repo string, sha string, subject string, path string")
    b = history.blast_radius(fixes, "src/").first()
    assert (b["n_bugfix_commits"], b["mean_files"], b["median_files"], b["max_files"]) == (3, 2.0, 2.0, 3)
    assert history.blast_radius(fixes.where("sha = 'f1'")).first()["mean_files"] is None


def test_statistics(spark):
    df = spark.createDataFrame([("x", float(v), float(w)) for v, w in ((1, 2), (2, 1), (2, 4), (3, 3), (5, 9))], "g string, a double, b double")
    ranks = [r["r"] for r in statistics.average_ranks(df, ["g"], "a", "r").orderBy("a").collect()]
    assert ranks == [1, 2.5, 2.5, 4, 5]
    constant = df.withColumn("c", F.lit(1.0))
    assert statistics.pearson(constant, ["g"], "a", "c").first()["r"] is None
    r = statistics.pearson(df, ["g"], "a", "b").first()["r"]
    p = statistics.with_p_value(statistics.pearson(df, ["g"], "a", "b")).first()["p_value"]
    assert 0 < p < 0.2 and r > 0.8
    assert pvalues.correlation_p(0.0014, 74) == pytest.approx(0.9906, abs=1e-4) and pvalues.correlation_p(1.0, 5) == 0.0 and pvalues.correlation_p(0.3, 2) is None
    assert pvalues.regularized_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    u = statistics.mann_whitney(df.withColumn("k", F.when(F.col("a") > 2, "hi").otherwise("lo")), "k", "hi", "a").first()
    assert u["u"] == 0.0 and u["p_value"] < 0.1
    assert statistics.lower_percentile(df, ["g"], "a").first()["value"] == 3.0


TEST = "def test_should_add_x(mocker):\n    assert 1\n    assert 2\n    assert 3\ndef test_b():\n    Order()\n"


def test_test_quality(spark):
    f = files(spark, [("tests/test_a.py", TEST), ("domain/order.py", "class Order:\n    pass\nclass Other:\n    pass\n")])
    r = quality(f).first()
    assert (r["assertion_density"], r["naming_quality"], r["isolation_score"], r["coverage_potential"], r["n_test_functions"]) == (0.5, 0.5, 0.5, 0.5, 2)
    assert r["test_to_code_ratio"] == 1.0 and r["test_score"] == pytest.approx(0.6)
    assert quality(files(spark, [("a.py", "x = 1")])).first()["test_score"] == 0.0


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, x double")
    assert engine.to_markdown(df) == "| name | x |\n|---|---|\n| a | 0.5000 |\n| b | n/a |"
    engine.write_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"name": "a", "x": 0.5}, {"name": "b"}]


def test_stream(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "graph_id string, ts timestamp, score double"

    def feed(rows):
        spark.createDataFrame(rows, "graph_id string, ts string, score double").select("graph_id", F.to_timestamp("ts").alias("ts"), "score").coalesce(1).write.mode("append").parquet(source)
        ratchet.watch(spark.readStream.schema(schema).parquet(source), state, ["score"], 0.05, str(tmp_path / "check")).awaitTermination(60)

    feed([("g", "2024-01-01 00:00:00", 0.7), ("g", "2024-01-02 00:00:00", 0.8)])
    feed([("g", "2024-01-03 00:00:00", 0.6), ("h", "2024-01-03 00:00:00", 0.1)])
    feed([("g", "2024-01-04 00:00:00", 0.76)])
    decided = sorted((r["epoch"], r["graph_id"], r["passed"]) for r in spark.read.parquet(f"{state}/decisions/epoch=0", f"{state}/decisions/epoch=1", f"{state}/decisions/epoch=2").collect())
    assert decided == [(0, "g", True), (1, "g", False), (1, "h", True), (2, "g", True)]


def test_running_sum_in_ranges(spark):
    df = spark.range(1000).selectExpr("if(id % 7 = 0, null, id % 3) as g", "id as x", "id % 5 + 1 as k")
    one = running_sum(df, ["g"], "x", "k", "s")
    many = running_sum(df, ["g"], "x", "k", "s", one_task=0)
    assert statistics.same_rows(one, many.select(*one.columns))
    assert statistics.same_rows(running_sum(df, [], "x", "k", "s"), running_sum(df, [], "x", "k", "s", one_task=0).select("g", "x", "k", "s"))
