"""Counts of triple patterns kept up to date as triples arrive (an addition; the batch operators do not need it).

Each micro-batch is reduced to its own counts and appended to a table of partial counts; readers merge the partials. A
batch that is run again after a failure writes to the same folder (its number), so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import grouping_sets


def start(triples: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """``triples``: a streaming (s, p, o). Null parts are left out; repeated triples count as they come."""

    def write(batch: DataFrame, number: int) -> None:
        grouping_sets(batch.where("s is not null and p is not null and o is not null")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return triples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """(kind, key, n) over all batches so far."""
    return spark.read.parquet(out).groupBy("kind", "key").agg(F.sum("n").alias("n"))
