"""Counters kept up to date by a stream: each micro-batch leaves its own additive counters, the total is their sum.

A batch writes into a folder named by its number, so a batch that is run again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators import stats


def run(stream: DataFrame, pairs: Column, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that counts ``pairs`` (see ``stats.record_pairs``) of every batch into ``out``."""

    def batch(df: DataFrame, number: int) -> None:
        stats.count_pairs(df, pairs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def total(spark, out: str) -> DataFrame:
    """The counters of all batches so far."""
    got = spark.read.schema("stat string, category string, n bigint, batch bigint").parquet(out)
    return got.groupBy("stat", "category").agg(F.sum("n").alias("n"))
