"""Counts batch by batch, each committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import grammar


def write_counts(counts: DataFrame, path: str, batch_id: int) -> None:
    """Counts of one batch in a folder of their own: writing it again replaces it, so nothing is counted twice."""
    counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_counts(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def committed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("batch_id").distinct()


def stream_structures(values: DataFrame, path: str, checkpoint: str, v: str = "v") -> StreamingQuery:
    """Counts structures of a stream of values. A batch that runs again after a failure replaces its own counts."""

    def one(batch: DataFrame, batch_id: int) -> None:
        write_counts(grammar.structure_counts(batch, v), path, batch_id)

    return values.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
