"""The ratchet gate over a stream of measurements (graph_id, ts and the watched values)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.policy import ratchet


def latest(batch: DataFrame) -> DataFrame:
    """The newest measurement of each graph in a batch."""
    others = [c for c in batch.columns if c != "graph_id"]
    return batch.groupBy("graph_id").agg(F.max_by(F.struct(*others), "ts").alias("m")).select("graph_id", "m.*")


def watch(stream: DataFrame, state: str, watched: Iterable[str], delta: float = 0.0, checkpoint: str | None = None) -> StreamingQuery:
    """Judge each micro-batch against the baseline kept under ``state``; passing graphs become their new baseline.

    A batch writes ``state/epoch=<n>`` from the folder before it, so repeating
    a failed batch gives the same state; decisions go to ``state/decisions``.
    """
    watched = list(watched)

    def judge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = latest(batch).select("graph_id", *watched)
        before = _read(spark, f"{state}/epoch={epoch - 1}")
        decided = ratchet(new, before, watched, delta)
        decided.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{state}/decisions/epoch={epoch}")
        failed = decided.where("not passed").select("graph_id").distinct()
        passed = new.join(failed, "graph_id", "left_anti")
        kept = passed if before is None else before.join(passed.select("graph_id"), "graph_id", "left_anti").unionByName(passed)
        kept.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(judge).outputMode("append").trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else None
