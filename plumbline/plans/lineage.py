"""Cutting lineage through the folder that driver and executors share, and sending the package to the executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

import plumbline


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; a lost executor costs nothing already written."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are written already; they would stay until the driver happens to collect garbage.

    Events that tell listeners of a query's end hold its plan, so they go first.
    """
    with contextlib.suppress(Py4JError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.sparkContext._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors through Spark, once per context; before any Python operator."""
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return
    root = Path(plumbline.__file__).parent
    archive = Path(tempfile.mkdtemp()) / "plumbline_sources.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._plumbline_shipped = True
