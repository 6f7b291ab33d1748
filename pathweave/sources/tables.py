"""Parquet tables by name, and the size check that stands before every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


#: Schemas of tables already opened, by path and time of change: reading one from the footers costs a job each time.
_SCHEMAS: dict[tuple[str, int], StructType] = {}


def changed(spark: SparkSession, path: str) -> int:
    """When the file or folder was last changed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = path, changed(spark, path)
    if key in _SCHEMAS:
        return spark.read.schema(_SCHEMAS[key]).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[key] = df.schema
    return df


def input_chunks(df: DataFrame) -> int:
    """About how many splits a scan of the files below ``df`` has, from their number and sizes; no job runs."""
    spark = df.sparkSession
    cores = max(1, spark.sparkContext.defaultParallelism)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size > 1 << 60:  # not known
        return cores
    conf = spark._jsparkSession.sessionState().conf()
    return max(cores, -(-(size + len(df.inputFiles()) * conf.filesOpenCostInBytes()) // conf.filesMaxPartitionBytes()))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's upper estimate of the size of ``df``; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is below ``limit``, else as it is (the join then shuffles)."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


#: The white space that is trimmed from codes.
WHITE = " \t\n\x0b\x0c\r\xa0"


def clean_code(c):
    """A property code trimmed of white space, in upper case; null if nothing is left."""
    return F.nullif(F.upper(F.btrim(c, F.lit(WHITE))), F.lit(""))
