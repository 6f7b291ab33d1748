"""Per-key results where a few keys hold most rows: multi-level tree aggregation.

The input is read in chunks of fixed size (Spark's file splits, or the partitions of a shuffle). Each chunk is combined
locally, so it sends one partial state per key, and the states are merged in rounds: round r puts the partials of
``fan_in`` neighbouring slots of a key together, the slots of the next round are those groups. A reducer therefore gets
at most ``fan_in`` states of a key, whatever share of the rows the key has, and the number of rounds is
log(chunks) / log(fan_in).

Defined results: a null key is a key of its own (null) unless ``drop_null``; null entities do not count as an entity;
an empty table gives no rows; duplicate rows count as they stand in ``rows``; columns beyond those named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import input_chunks

SLOT = "__slot"
#: Names of merge functions, by column: partial states are merged with the same function.
MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(df: DataFrame, keys: list[str], states: dict[str, tuple[Column, str]], fan_in: int = 16, chunks: int = 0) -> DataFrame:
    """``states``: output column -> (value of one row, ``sum``/``min``/``max``). One row per key.

    ``chunks``: how many chunks the input has; 0: as its files' sizes let expect. No job runs to find out, and the result
    does not depend on it: with more chunks than expected the last round gets that much more.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    chunks = chunks or input_chunks(df)
    cur = df.select(*keys, *[v.alias(n) for n, (v, _) in states.items()], F.spark_partition_id().alias(SLOT))
    while True:
        chunks = -(-chunks // fan_in)
        last = chunks == 1
        by = [*keys] if last else [*keys, SLOT]
        if not last:
            cur = cur.withColumn(SLOT, F.floor(F.col(SLOT) / fan_in).cast("int"))
        cur = cur.groupBy(*by).agg(*[MERGE[m](n).alias(n) for n, (_, m) in states.items()])
        if last:
            return cur.select(*keys, *states)


def key_profile(df: DataFrame, key: str, entity: str, fan_in: int = 16, drop_null: bool = True) -> DataFrame:
    """(key, n_rows, n_entities): rows and distinct non-null entities of each key.

    Distinct entities come from a first grouping by (key, entity), which spreads a hot key over all tasks; its counts
    then go up the tree.
    """
    src = df.select(F.col(key).alias("key"), F.col(entity).alias("entity"))
    if drop_null:
        src = src.where(F.col("key").isNotNull())
    pairs = src.groupBy("key", "entity").agg(F.count(F.lit(1)).alias("n"))
    return tree_aggregate(pairs, ["key"], {"n_rows": (F.col("n"), "sum"), "n_entities": (F.col("entity").isNotNull().cast("long"), "sum")}, fan_in, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(fields: dict[str, Column | DataFrame], min_share: float, fan_in: int = 16) -> DataFrame:
    """(field, key_value, n_rows, share) of the keys with at least ``min_share`` of the non-null rows of their field.

    ``fields``: label -> one-column DataFrame of the key.
    """
    parts = []
    for label, one in fields.items():
        col = one.columns[0]
        counts = tree_aggregate(one.where(F.col(col).isNotNull()), [col], {"n_rows": (F.lit(1).cast("long"), "sum")}, fan_in)
        parts.append(counts.select(F.lit(label).alias("field"), F.col(col).cast("string").alias("key_value"), "n_rows"))
    counts = reduce(DataFrame.unionByName, parts)
    shuffled = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")) * len(parts)
    totals = tree_aggregate(counts, ["field"], {"total": (F.col("n_rows"), "sum")}, fan_in, shuffled)  # a row per field named
    out = counts.join(F.broadcast(totals), "field").withColumn("share", F.col("n_rows") / F.col("total"))
    return out.where(F.col("n_rows") >= F.lit(min_share) * F.col("total")).select("field", "key_value", "n_rows", "share")


#: Consecutive numbers of a bucket of running sums.
BUCKET_ROWS = 50_000


def running(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` up to and with the row, in the order of the unique integer ``order``
    (within ``by``), in two steps over buckets of ``BUCKET_ROWS`` consecutive numbers."""
    r = rows.withColumn("__bucket", F.floor(F.col(order) / BUCKET_ROWS))
    sums = r.groupBy(*by, "__bucket").agg(F.sum(value).alias("__m"))
    one = [F.lit(1)] if not by else by
    before = sums.select(*by, "__bucket", F.coalesce(F.sum("__m").over(W.partitionBy(*one).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.sum(value).over(W.partitionBy(*by, "__bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn("__inside", inside).join(before, [*by, "__bucket"]).withColumn(name, F.col("__base") + F.col("__inside")).drop("__bucket", "__base", "__inside")
