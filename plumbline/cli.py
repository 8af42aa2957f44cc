"""Command line: score a project against a gate, or propose boundaries for it.

    python -m plumbline score PATH --threshold 0.7 --constraints rules.json --baseline last.json
    python -m plumbline discover --graph graph.json --output-constraints rules.json

The exit code is 0 if the gate passes, 1 if it fails, 2 for wrong arguments. A
constraint file has a list of rules or an object with a list ``constraints``.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.operators import policy
from plumbline.operators.graph import Graph
from plumbline.plans import engine
from plumbline.sources import code, tables

METRICS = ("modularity", "acyclicity", "stability", "cohesion")


def weights(text: str) -> tuple[float, ...]:
    values = tuple(float(x) for x in text.split(","))
    if len(values) != len(METRICS):
        raise argparse.ArgumentTypeError("four weights are needed: " + ",".join(METRICS))
    return values


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="plumbline", description="Structural quality of software from its dependency graph")
    commands = out.add_subparsers(dest="command", required=True)
    score = commands.add_parser("score", help="measure a project and check it against a gate")
    score.add_argument("--threshold", type=float, default=0.7, help="least score that passes (default 0.7)")
    score.add_argument("--constraints", metavar="FILE", help="forbidden dependencies as JSON")
    score.add_argument("--min-constraint-score", type=float, default=0.95, help="least constraint score that passes (default 0.95)")
    score.add_argument("--baseline", metavar="FILE", help="an earlier report; neither score may fall below it")
    score.add_argument("--delta", type=float, default=0.0, help="how far below the baseline is still right (default 0)")
    score.add_argument("--weights", type=weights, default=(0.25,) * 4, metavar="M,A,S,C", help="weights of " + ", ".join(METRICS))
    discover = commands.add_parser("discover", help="find clusters of modules and propose rules between them")
    discover.add_argument("--min-confidence", type=float, default=0.5, help="least confidence of a proposed rule (default 0.5)")
    discover.add_argument("--output-constraints", metavar="FILE", help="write the sure rules in the form that score --constraints takes")
    for command in (score, discover):
        command.add_argument("path", nargs="?", default=".", help="folder of the project")
        command.add_argument("--graph", metavar="FILE", help="a dependency graph as JSON instead of a folder")
        command.add_argument("--output-json", metavar="FILE", help="write the report")
    return out


def _project(spark: SparkSession, args: argparse.Namespace) -> tuple[Graph, DataFrame | None, DataFrame | None]:
    """Graph, class components and language."""
    if args.graph:
        return *tables.read_graph_json(spark, args.graph), None
    return engine.scan(code.read_files(spark, str(Path(args.path).resolve())))


def score(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The report of the one project: gate, scores, metrics, sizes, failures."""
    g, lcom4, languages = _project(spark, args)
    current = scores.enhance(engine.measure(g, lcom4, languages, args.weights))
    watched = ["score"]
    if args.constraints:
        raw = json.loads(Path(args.constraints).read_text())
        rules = policy.rules_table(spark, raw if isinstance(raw, list) else raw.get("constraints", []))
        checked = policy.constraint_score(g.edges, policy.violations(g.edges, rules)).select("graph_id", "constraint_score")
        current = current.join(checked, "graph_id", "left").withColumn("constraint_score", F.coalesce("constraint_score", F.lit(1.0)))
        watched.append("constraint_score")
    row = current.first()
    if row is None:
        return {"gate": "FAIL", "score": None, "threshold": args.threshold, "failures": ["no source files or nodes found"]}
    least = {"score": args.threshold, "constraint_score": args.min_constraint_score}
    failures = [f"{k} {row[k]:.4f} is below {least[k]:.2f}" for k in watched if row[k] < least[k]]
    if args.baseline:
        before = json.loads(Path(args.baseline).read_text())
        old = spark.createDataFrame([(row["graph_id"], *(before.get(k) for k in watched))], "graph_id string, " + ", ".join(f"{k} double" for k in watched))
        now = spark.createDataFrame([(row["graph_id"], *(row[k] for k in watched))], old.schema)
        failures += [f"{r['metric']} {r['value']:.4f} fell below the baseline {r['baseline']:.4f}" for r in policy.ratchet(now, old, watched, args.delta).where("not passed").orderBy("metric").collect()]
    report = {
        "gate": "FAIL" if failures else "PASS", "threshold": args.threshold, "language": row["language"], "fingerprint": row["fingerprint"],
        "cycle_severity": row["cycle_severity"]["severity_level"], "metrics": {k: round(row[k], 4) for k in METRICS}, "graph": {"nodes": row["nodes"], "edges": row["edges"]}, "failures": failures,
    }
    return report | {k: round(row[k], 4) for k in watched}


def discover(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The report of the one project: clusters by size, rules by confidence, summary, and the sure rules as constraints."""
    clusters, rules, summary = engine.discovery(_project(spark, args)[0], args.min_confidence)
    rows = [r.asDict() for r in rules.drop("graph_id").orderBy(F.desc("confidence"), "rule_from", "rule_to").collect()]
    figures = summary.drop("graph_id").first()
    return {
        "clusters": [r.asDict() for r in clusters.drop("graph_id").orderBy(F.desc("size"), "label").collect()],
        "proposed_rules": rows, "graph_summary": figures.asDict() if figures else {},
        "constraints": [{"name": f"{r['rule_from']} to {r['rule_to']}", "type": "forbidden", "from": r["rule_from"], "to": r["rule_to"], "rationale": r["rationale"]} for r in rows if r["confidence"] >= engine.SURE],
    }


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("plumbline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        report = {"score": score, "discover": discover}[args.command](spark, args)
    finally:
        if own:
            spark.stop()
    if args.output_json:
        Path(args.output_json).write_text(json.dumps(report, indent=2))
    if args.command == "discover":
        for c in report["clusters"]:
            print(f"{c['label']}: {c['size']} modules")
        for r in report["proposed_rules"]:
            print(f"{r['confidence']:.0%} forbid {r['rule_from']} to {r['rule_to']}: {r['rationale']}")
        if args.output_constraints:
            Path(args.output_constraints).write_text(json.dumps(report["constraints"], indent=2))
        return 0
    print(f"gate {report['gate']}", *(f"{k} {v}" for k, v in {"score": report["score"], **report.get("metrics", {})}.items()))
    for failure in report["failures"]:
        print(failure, file=sys.stderr)
    return int(bool(report["failures"]))
