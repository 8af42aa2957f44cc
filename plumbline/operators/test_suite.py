"""Quality of a Python project's test suite from its files (graph_id, path, text)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.lineage import ship_package
from plumbline.sources.code import lines_of_code

#: Words of descriptive test names, marks of isolation, names of assertions.
DESCRIPTIVE = r"(?i)test_(should|when|given|if|that|returns|raises|handles|with|without|can|cannot|does|does_not|will|wont|is|is_not|has|has_no)_"
ISOLATION = ("mock", "patch", "fixture", "mocker", "monkeypatch", "Mock", "MagicMock", "AsyncMock")
ASSERTIONS = (
    "assert", "assertEqual", "assertNotEqual", "assertTrue", "assertFalse", "assertIn", "assertNotIn", "assertIsNone", "assertIsNotNone", "assertRaises", "assertAlmostEqual",
    "assert_called", "assert_called_once", "assert_called_with", "assert_called_once_with", "assert_any_call", "assert_not_called",
)

IS_TEST = r"(^|/)test_[^/]*\.py$"


def _called(node: ast.AST) -> str:
    target = node.func if isinstance(node, ast.Call) else node
    return target.attr if isinstance(target, ast.Attribute) else target.id if isinstance(target, ast.Name) else ""


def test_rows(text: str) -> tuple[list[dict], list[str]]:
    """Test functions with their assertions and isolation, and all names that the file mentions."""
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    tests = []
    for node in nodes:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) and node.name.startswith("test_"):
            inner = list(ast.walk(node))
            calls = [_called(x) for x in inner if isinstance(x, ast.Call)]
            asserted = sum(isinstance(x, ast.Assert) for x in inner) + sum(c in ASSERTIONS for c in calls)
            marks = [_called(d) for d in node.decorator_list] + calls
            isolated = any(m in ISOLATION for m in marks) or any(a.arg in {m.lower() for m in ISOLATION} for a in node.args.args)
            tests.append({"name": node.name, "assertions": asserted, "isolated": isolated})
    names = {x.id for x in nodes if isinstance(x, ast.Name)} | {x.attr for x in nodes if isinstance(x, ast.Attribute)}
    return tests, sorted(names)


def scan_tests(files: DataFrame) -> DataFrame:
    """graph_id, path, tests (array of name, assertions, isolated), names of each test file."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [test_rows(t or "") for t in batch["text"]]
            yield batch[["graph_id", "path"]].assign(tests=[f[0] for f in found], names=[f[1] for f in found])

    ship_package(files.sparkSession)
    tests = files.where(F.col("path").rlike(IS_TEST)).select("graph_id", "path", "text")
    return tests.mapInPandas(read, "graph_id string, path string, tests array<struct<name:string,assertions:int,isolated:boolean>>, names array<string>")


def domain_classes(files: DataFrame, directories: Sequence[str] = ("domain",)) -> DataFrame:
    """graph_id, name of the classes below the given directories, test files left out."""
    inside = F.col("path").rlike(rf"(^|/)({'|'.join(map(re.escape, directories))})/") & ~F.col("path").rlike(IS_TEST)
    return files.where(inside).select("graph_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*class\s+(\w+)"), F.lit(1))).alias("name")).distinct()


def test_quality(files: DataFrame, directories: Sequence[str] = ("domain",)) -> DataFrame:
    """graph_id and five ratios from 0 to 1 with their mean; all 0 for a project without test files.

    Assertions a test (3 are enough), test to production lines, descriptive
    names, isolated tests, and domain classes that tests mention (1 without any).
    """
    is_test = F.col("path").rlike(IS_TEST)
    lines = lines_of_code(F.coalesce("text", F.lit("")))
    size = files.where(F.col("path").endswith(".py")).groupBy("graph_id").agg(F.sum(F.when(is_test, lines)).alias("test_loc"), F.coalesce(F.sum(F.when(~is_test, lines)), F.lit(0)).alias("loc"), F.count(F.when(is_test, 1)).alias("n_test_files"))
    scanned = scan_tests(files)
    one = scanned.select("graph_id", F.explode("tests").alias("t"))
    tests = one.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_test_functions"), F.avg("t.assertions").alias("a"), F.avg(F.col("t.name").rlike(DESCRIPTIVE).cast("double")).alias("d"), F.avg(F.col("t.isolated").cast("double")).alias("i")
    )
    domain = domain_classes(files, directories)
    tested = scanned.select("graph_id", F.explode("names").alias("name")).distinct().withColumn("t", F.lit(1))
    coverage = domain.join(tested, ["graph_id", "name"], "left").groupBy("graph_id").agg(F.avg(F.when(F.col("t").isNotNull(), 1.0).otherwise(0.0)).alias("c"))
    rows = size.join(tests, "graph_id", "left").join(coverage, "graph_id", "left")
    any_file = F.col("n_test_files") > 0
    ratio = lambda c: F.when(any_file, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    rows = rows.select(
        "graph_id", ratio(F.least(F.col("a") / 3.0, F.lit(1.0))).alias("assertion_density"), ratio(F.least(F.col("test_loc") / F.greatest("loc", F.lit(1)), F.lit(1.0))).alias("test_to_code_ratio"),
        ratio(F.col("d")).alias("naming_quality"), ratio(F.col("i")).alias("isolation_score"), F.when(any_file, F.coalesce("c", F.lit(1.0))).otherwise(0.0).alias("coverage_potential"),
        "n_test_files", F.coalesce("n_test_functions", F.lit(0)).alias("n_test_functions"),
    )
    five = ("assertion_density", "test_to_code_ratio", "naming_quality", "isolation_score", "coverage_potential")
    mean = F.lit(0.0)
    for c in five:
        mean = mean + F.col(c)
    return rows.withColumn("test_score", mean / 5.0)
