"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.lineage import shared_dir, ship_package


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it for ``body``, even inside higher-order functions.

    A plain column reference may be inlined by the optimizer into a lambda and
    would then be evaluated again for each element.
    """
    return F.transform(F.array(value), body)[0]


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def materialize(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: for a scan the size of its files, so the real size is within their compression of it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """Broadcast hint only if the size estimate is below ``limit``; else the planner chooses."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python operators: small Arrow batches, so that long texts don't add up in a worker, and the package on all executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    ship_package(spark)
