"""Has this key come before? An exact ledger of keys on disk, in buckets by hash of the key, that outlives the process.

A ledger is a folder: generations of keys (tables in buckets by key, sorted within them, one file a bucket) and manifests
that name them. ``Ledger(spark, path)`` opens it, in any process; ``feed`` judges a batch and appends its new keys.

A batch is ranked by arrival: within blocks of ``BLOCK`` consecutive ids first, so that a key that holds a third of the
rows is spread over many tasks (ids are unique, so a block has at most ``BLOCK`` rows), then the heads of the blocks among
themselves. Rows that are not their block's first are repeats. The heads are moved once, by hash of the key, and
left-joined by sort and merge to every generation, the first batch included; a head is new if it is its key's first and
no generation has the key. Heads and verdicts are written as the next generation, in buckets, in the same job, and the
manifest that names it is put in place by a rename: a batch is either in the ledger or not. A batch fed again under its
name gets the answers it got. When ``FAN`` generations of a level exist they are merged into one of the next level, so
their number grows with the logarithm of the batches; files of merged generations stay until ``vacuum``.

Keys are compared as whole texts: no answer is wrong, which ``audit`` confirms row by row. No key is kept in memory.

Defined results: null keys are never repeats and never enter the ledger; rows without id are left out; an id given twice
with the same key is one row; an empty batch gives no rows; other columns are not read. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import drop_path, scratch

#: Ids of a block of arrivals; generations of a level that are merged.
BLOCK, FAN = 65_536, 6
# White space and separators, as ranges (a class of properties is several times slower).
WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
GENERATION = "key string, id long, seen boolean"
RANKED = "id long, key string, block long, batch int, head boolean"


def text_key(scope: str, text: str) -> Column:
    """Key of ``text`` within ``scope``: white space trimmed and inner runs taken as one space; null if text is null or blank."""
    t = F.btrim(F.regexp_replace(F.col(text), WHITE, " "), F.lit(" "))
    return F.when(t != "", F.concat(F.coalesce(F.col(scope).cast("string"), F.lit("")), F.lit("\x1f"), t))


def arrivals(rows: DataFrame, batch: Column) -> DataFrame:
    """(id, key, block, batch, head), written once, heads and others apart: ``head`` tells whether the row is the first, by
    id, among those of its batch, key and block. Only heads keep their key, the rest needs no more than its id."""
    src = rows.where("id is not null and key is not null").select(F.col("id").cast("long").alias("id"), "key", batch.cast("int").alias("batch"), F.floor(F.col("id") / BLOCK).alias("block"))
    w = W.partitionBy("batch", "key", "block").orderBy("id")
    ranked = src.withColumn("head", F.row_number().over(w) == 1).withColumn("last", F.lag("id").over(w)).where("last is null or last <> id")
    path = scratch(rows.sparkSession, "arrivals")
    ranked.select("id", F.when(F.col("head"), F.col("key")).alias("key"), "block", "batch", "head").write.partitionBy("batch", "head").parquet(path)
    return rows.sparkSession.read.schema(RANKED).parquet(path)


class Ledger:
    """The ledger in the folder ``path``; it is made if there is none. ``buckets`` 0: as many as shuffle partitions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 0):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.state = self._newest()
        self.state.setdefault("buckets", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    # files ----------------------------------------------------------------------------------------------------------

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _newest(self) -> tuple[int, dict]:
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*.json"))
        names = sorted(s.getPath().getName() for s in found) if found else []
        if not names:
            return 0, {"generations": [], "batches": {}}
        stream = self._fs.open(self._path(f"{self.path}/{names[-1]}"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return int(names[-1][9:-5]), json.loads(text)

    def _commit(self, state: dict) -> None:
        to = self._path(f"{self.path}/manifest-{self.version + 1:09d}.json")
        draft = self._path(f"{self.path}/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(draft, to):
            raise RuntimeError("another writer has changed the ledger")
        self.version, self.state = self.version + 1, state

    def _write(self, df: DataFrame, folder: str) -> None:
        name = f"pathweave_{uuid.uuid4().hex}"
        df.write.bucketBy(self.state["buckets"], "key").sortBy("key").format("parquet").option("path", f"{self.path}/{folder}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def _tables(self) -> list[str]:
        """The generations as tables of this session: in buckets and sorted, so that a merge join reads them as they lie."""
        names = []
        for g in self.state["generations"]:
            name = f"pathweave_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({GENERATION}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{g['folder']}'")
            names.append(name)
        return names

    # batches --------------------------------------------------------------------------------------------------------

    def feed(self, rows: DataFrame, batch: str) -> DataFrame:
        """(id, seen) for each row of ``rows`` (id, key), whose ids come after those of earlier batches; ``batch`` names it."""
        if batch in self.state["batches"]:
            return self._answers(batch)
        return self.judge(arrivals(rows, F.lit(0)), batch)

    def judge(self, ranked: DataFrame, batch: str) -> DataFrame:
        """``feed`` of rows that ``arrivals`` has ranked."""
        if batch in self.state["batches"]:
            return self._answers(batch)
        folder, rest = f"generation-{uuid.uuid4().hex}", f"repeats-{uuid.uuid4().hex}"
        heads = ranked.where("head").select("key", "id", "block").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("block")))
        known = self._tables()
        new = Observation()
        order = self.spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering")
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one sorted file: it is not sorted again
        try:
            for k, name in enumerate(known):
                heads = heads.join(self.spark.table(name).where("not seen").select("key", F.lit(True).alias(f"in_{k}")).hint("merge"), "key", "left")
            seen = reduce(lambda a, b: a | b, [F.col(f"in_{k}").isNotNull() for k in range(len(known))], F.col("n") > 1)
            self._write(heads.select("key", "id", seen.alias("seen")).observe(new, F.count_if(~F.col("seen")).alias("n")), folder)
        finally:
            self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", order)
            for name in known:
                self.spark.sql(f"DROP TABLE {name}")
        ranked.where("not head").select("id").write.parquet(f"{self.path}/{rest}")
        generation = {"folder": folder, "rows": new.get["n"], "level": 0}
        self._commit(self.state | {"generations": [*self.state["generations"], generation], "batches": self.state["batches"] | {batch: [folder, rest]}})
        self._merge()
        return self._answers(batch)

    def _answers(self, batch: str) -> DataFrame:
        folder, rest = self.state["batches"][batch]
        heads = self.spark.read.schema(GENERATION).parquet(f"{self.path}/{folder}").select("id", "seen")
        return heads.unionByName(self.spark.read.schema("id long").parquet(f"{self.path}/{rest}").select("id", F.lit(True).alias("seen")))

    def _merge(self) -> None:
        while True:
            by: dict[int, list[dict]] = {}
            for g in self.state["generations"]:
                by.setdefault(g["level"], []).append(g)
            full = next((lv for lv, gs in sorted(by.items()) if len(gs) >= FAN), None)
            if full is None:
                return
            folder, mine = f"generation-{uuid.uuid4().hex}", by[full]
            parts = [self.spark.read.schema(GENERATION).parquet(f"{self.path}/{g['folder']}").where("not seen") for g in mine]
            self._write(reduce(DataFrame.unionByName, parts).repartition(self.state["buckets"], "key"), folder)
            rest = [g for g in self.state["generations"] if g not in mine]
            self._commit(self.state | {"generations": [{"folder": folder, "rows": sum(g["rows"] for g in mine), "level": full + 1}, *rest]})

    def keys(self) -> DataFrame:
        """(key, id): every key of the ledger with the id that brought it."""
        parts = [self.spark.read.schema(GENERATION).parquet(f"{self.path}/{g['folder']}").where("not seen").select("key", "id") for g in self.state["generations"]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "key string, id long")

    def vacuum(self, forget: tuple[str, ...] = ()) -> None:
        """Removes what no manifest needs: drafts, older manifests, failed and merged generations. The answers of the
        batches named in ``forget`` go, too; a batch that is forgotten must not be fed again."""
        state = self.state | {"batches": {b: f for b, f in self.state["batches"].items() if b not in forget}}
        if forget:
            self._commit(state)
        keep = {g["folder"] for g in state["generations"]} | {f for fs in state["batches"].values() for f in fs} | {f"manifest-{self.version:09d}.json"}
        for s in self._fs.listStatus(self._path(self.path)):
            if s.getPath().getName() not in keep:
                self._fs.delete(s.getPath(), True)


def stream(rows: DataFrame, batches: int = 4, ledger: Ledger | None = None, name: str = "part") -> DataFrame:
    """(id, seen) of a table (id, key) that is fed to ``ledger`` (a new one, if None) in ``batches`` stretches of ids."""
    spark = rows.sparkSession
    ledger = ledger or Ledger(spark, scratch(spark, "ledger"))
    lo, hi = rows.where("key is not null").agg(F.min("id"), F.max("id")).first()
    if lo is None:
        return spark.createDataFrame([], "id long, seen boolean")
    width = -(-(hi - lo + 1) // batches)
    ranked = arrivals(rows, F.floor((F.col("id") - lo) / width))
    return reduce(DataFrame.unionByName, [ledger.judge(ranked.where(F.col("batch") == k), f"{name}-{k}") for k in range(batches)])


def repeats(rows: DataFrame, batches: int = 4) -> DataFrame:
    """(id) of the rows of (id, key) whose key came with a smaller id."""
    return stream(rows, batches).where("seen").select("id")


def audit(rows: DataFrame, batches: int = 4) -> DataFrame:
    """One row: n_rows, n_null, n_new, n_repeat, n_wrong, wrong_rate. Each answer is held against the least id of its key,
    found apart from the ledger: ``n_wrong`` counts the rows that one calls new and the other does not, or that have no answer."""
    count = F.count(F.lit(1)).cast("long")
    keyed = rows.where("id is not null and key is not null")
    first = keyed.groupBy("key").agg(F.min("id").alias("id")).select(F.col("id").cast("long").alias("id"), F.lit(True).alias("first"))
    asked = keyed.select(F.col("id").cast("long").alias("id"), F.lit(True).alias("asked"))
    both = asked.join(stream(rows, batches), "id", "full").join(first, "id", "left")
    right = F.col("asked").isNotNull() & F.col("seen").isNotNull() & (F.col("seen") == F.col("first").isNull())
    judged = both.agg(F.count_if(~F.col("seen")).alias("n_new"), F.count_if("seen").alias("n_repeat"), F.count_if(~right).alias("n_wrong"))
    every = rows.agg(count.alias("n_rows"), F.count_if(F.col("key").isNull()).alias("n_null"))
    return every.join(F.broadcast(judged), F.lit(True)).select("n_rows", "n_null", "n_new", "n_repeat", "n_wrong", F.coalesce(F.col("n_wrong") / F.nullif("n_rows", F.lit(0)), F.lit(0.0)).alias("wrong_rate"))  # two single rows


def forget(spark, path: str) -> None:
    """Removes a ledger's files."""
    drop_path(spark, path)
