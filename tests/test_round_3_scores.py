"""Findings of the third round on scores."""

import random

from plumbline.operators import statistics as st


def test_study_verdict_computes_its_rows_once(spark):
    """Scores that differ in a last digit each time they are computed still all find their ranks."""
    seen = spark.sparkContext.accumulator(0)

    def value(r):
        seen.add(1)
        return (*r, random.random(), 0.5)

    rows = spark.sparkContext.parallelize([("a", d % 5) for d in range(40)], 2).map(value)
    found = {r["kind"]: r["n"] for r in st.study_verdict(spark.createDataFrame(rows, "kind string, dose int, x double, base double"), "kind", "dose", "x", "base").collect()}
    assert found == {"a": 40, "combined": 40} and seen.value == 40
