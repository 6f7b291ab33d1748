"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []
_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent and the master is a single JVM (tests, local runs) a temporary folder is made once
    per process. On a cluster without the setting an error is raised, since a machine-local folder would lose data.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="pathweave-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back: lineage is gone, executors may be lost, the
    plan that made it runs once (an eager checkpoint would run its last stage twice) and its true size is known to Catalyst.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *by: str) -> DataFrame:
    """``cut`` into buckets by hash of ``by``, sorted within: joins and groupings on these columns read it without moving it.
    There are as many buckets as shuffle partitions."""
    spark = df.sparkSession
    n, name, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"pathweave_{uuid.uuid4().hex}", scratch(spark, "buckets")
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).format("parquet").option("path", path).saveAsTable(name)
    _TABLES.append(name)
    return spark.table(name)


def together(*steps):
    """The results of steps that do not depend on one another; their jobs run side by side, so that small ones fill the cluster."""
    own = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(own(step)) for step in steps]]


def clean(spark: SparkSession) -> None:
    """Removes the tables that this process has written below the shared folder; frames built on them can no longer be read."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _WRITTEN:
        drop_path(spark, _WRITTEN.pop())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``clean`` removes it, and so does the end of the process where it is a plain file path."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@atexit.register
def _sweep() -> None:
    for path in _WRITTEN:
        if re.match(r"(file:)?/", path):
            shutil.rmtree(re.sub(r"^file:/+", "/", path), ignore_errors=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
