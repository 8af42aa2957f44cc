"""Running sums in the order of a value, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.lineage import materialize

#: Up to this estimate of the table's size a group is ordered in one task.
ONE_TASK = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate: for scans, filters and aggregates at least the size of the files, so the real size is within their compression of it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def running_sum(df: DataFrame, by: Sequence[str], x: str, k: str, out: str, one_task: int = ONE_TASK) -> DataFrame:
    """Adds the sum of k over the rows of the group up to this x. Rows are distinct in (by, x).

    A large table is dealt by ranges of (by, x) and written; sums within a
    range are local, and the ranges before it add their totals, of which there
    is one for each range and group.
    """
    if estimated_bytes(df) <= one_task:
        return df.withColumn(out, F.sum(k).over(Window.partitionBy(*by).orderBy(x)))
    parts = materialize(df.repartitionByRange(*by, x).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*by, "_part").agg(F.sum(k).alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_total")
    totals = totals.select(*by, "_part", before.alias("_before"))
    inner = parts.withColumn("_inner", F.sum(k).over(Window.partitionBy(*by, "_part").orderBy(x)))
    # Null group keys are groups too.
    names = [f"_g{i}" for i in range(len(by))]
    same = F.col("_part") == F.col("_p")
    for b, n in zip(by, names, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(n))
    return inner.join(totals.toDF(*names, "_p", "_before"), same).withColumn(out, F.col("_inner") + F.col("_before")).drop("_inner", "_before", "_part", "_p", *names)
