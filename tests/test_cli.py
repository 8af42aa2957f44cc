"""The command line on small projects, and the discovery report."""

import json

import pytest

from plumbline import cli
from plumbline.operators import statistics as st

GROUPS = ("pay", "user")
EDGES = [(f"{g}.m{i}", f"{g}.m{j}") for g in GROUPS for i in range(6) for j in range(6) if i < j] + [("pay.m0", "user.m5")]


@pytest.fixture
def graph_file(tmp_path):
    path = tmp_path / "project.json"
    path.write_text(json.dumps({"nodes": [{"id": f"{g}.m{i}", "internal": True} for g in GROUPS for i in range(6)], "edges": EDGES}))
    return str(path)


def test_score_gate(spark, tmp_path, graph_file, capsys):
    out = tmp_path / "report.json"
    assert cli.main(["score", "--graph", graph_file, "--threshold", "0.1", "--output-json", str(out)], spark) == 0
    report = json.loads(out.read_text())
    assert report["gate"] == "PASS" and report["graph"] == {"nodes": 12, "edges": 31} and report["metrics"]["acyclicity"] == 1.0
    assert cli.main(["score", "--graph", graph_file, "--threshold", "0.99"], spark) == 1
    assert "score" in capsys.readouterr().err
    out.write_text(json.dumps({"score": 1.0}))
    assert cli.main(["score", "--graph", graph_file, "--threshold", "0.1", "--baseline", str(out)], spark) == 1
    assert "baseline" in capsys.readouterr().err


def test_discovered_rules_are_constraints(spark, tmp_path, graph_file):
    out, rules = tmp_path / "found.json", tmp_path / "rules.json"
    assert cli.main(["discover", "--graph", graph_file, "--output-json", str(out), "--output-constraints", str(rules)], spark) == 0
    report = json.loads(out.read_text())
    assert [(c["label"], c["size"]) for c in report["clusters"]] == [("pay", 6), ("user", 6)]
    assert [(r["rule_from"], r["rule_to"], r["size_from"], r["a_to_b"]) for r in report["proposed_rules"]] == [("user/*", "pay/*", 6, 1)]
    assert report["graph_summary"] == {"nodes": 12, "internal_nodes": 12, "edges": 31, "clusters": 2, "rules": 1, "sure_rules": 1}
    assert cli.main(["score", "--graph", graph_file, "--threshold", "0.1", "--constraints", str(rules)], spark) == 0
    rules.write_text(json.dumps({"constraints": [{"type": "forbidden", "from": "pay/*", "to": "*"}]}))
    assert cli.main(["score", "--graph", graph_file, "--threshold", "0.1", "--constraints", str(rules)], spark) == 1


def test_score_folder(spark, tmp_path):
    project = tmp_path / "shop"
    (project / "cart").mkdir(parents=True)
    (project / "cart" / "a.py").write_text("import cart.b\n\nclass A:\n    def f(self):\n        return self.x\n")
    (project / "cart" / "b.py").write_text("import os\n")
    assert cli.main(["score", str(project), "--threshold", "0.0", "--weights", "0,1,0,0"], spark) == 0
    (tmp_path / "empty").mkdir()
    assert cli.main(["score", str(tmp_path / "empty"), "--threshold", "0.0"], spark) == 1


def test_wrong_arguments(spark):
    with pytest.raises(SystemExit):
        cli.main(["score", "--weights", "1,2"], spark)


@pytest.mark.parametrize("a, b, c, verdict", [(0.9, 0.9, 0.1, "full_mediation"), (0.9, 0.9, 0.8, "partial_mediation"), (0.9, 0.0, 0.8, "path_a_significant"), (0.1, 0.9, 0.8, "no_mediation")])
def test_mediation_verdict(spark, a, b, c, verdict):
    found = spark.createDataFrame([(40, a, b, c, a * b, 2.0)], "n long, r_a double, r_b double, r_c double, indirect double, sobel_z double")
    row = st.mediation_verdict(found).first()
    assert row["verdict"] == verdict and row["sobel_p"] == pytest.approx(0.0455, abs=1e-4)


def test_study_verdict(spark):
    falls = [("a", d, 1 - d / 10, 0.9) for d in range(1, 7)]
    flat = [("b", d, 0.5 + 0.01 * (d % 2), 0.5) for d in range(1, 7)]
    few = [("c", 1, 0.5, 0.5)]
    rows = {r["kind"]: r for r in st.study_verdict(spark.createDataFrame([*falls, *flat, *few], "kind string, dose int, x double, base double"), "kind", "dose", "x", "base").collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"a": "PASS", "b": "FAIL", "c": "SKIP", "combined": "FAIL"}
    assert rows["a"]["d"] == pytest.approx((0.9 - 0.4) / 0.01) and rows["combined"]["d"] is None and rows["combined"]["n"] == 13
