"""Triples, adjacency, degrees, dictionaries and filters of a knowledge graph.

Nulls: a triple with a null part is left out. Repeated triples count once in ``triples`` and ``adjacency``; ``edges`` is
the same relation with repetitions, for operators that remove duplicates from their (much smaller) result instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DBPEDIA, KnowledgeBase
from ..session import bucketed, cut, exists, scratch, together
from ..sources.tables import changed, small, table


def _code(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(s, p, o) of the warehouse tables, with repetitions: pure projections of scans."""

    def rel(name: str, s: tuple[str, str], p: str, o: tuple[str, str]) -> DataFrame:
        return table(spark, d, name).select(_code(*s).alias("s"), F.lit(p).alias("p"), _code(*o).alias("o")).where("s is not null and o is not null")

    c, s, n, o, p = ("c", "c_custkey"), ("s", "s_suppkey"), ("n", "n_nationkey"), ("o", "o_orderkey"), ("p", "l_partkey")
    parts = [
        rel("customer", c, "P1", ("n", "c_nationkey")),
        rel("supplier", s, "P1", ("n", "s_nationkey")),
        rel("nation", n, "P2", ("r", "n_regionkey")),
        rel("orders", o, "P3", ("c", "o_custkey")),
        rel("lineitem", ("o", "l_orderkey"), "P4", p),
        rel("lineitem", p, "P5", ("s", "l_suppkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


def with_inverse(e: DataFrame) -> DataFrame:
    """Each edge in both directions from one read; the inverse property is marked with ``@``."""
    both = F.array(F.struct("s", "p", "o"), F.struct(F.col("o").alias("s"), toggle(F.col("p")).alias("p"), F.col("s").alias("o")))
    return e.select(F.explode(both).alias("e")).select("e.s", "e.p", "e.o")


def toggle(p: Column) -> Column:
    """The property of the opposite direction."""
    return F.when(p.endswith("@"), F.regexp_replace(p, "@$", "")).otherwise(F.concat(p, F.lit("@")))


def triples(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).distinct()


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return with_inverse(triples(spark, d))


@dataclass(frozen=True)
class Stored:
    """A graph on disk: its distinct triples twice, in a folder per property, sorted by subject and by object, so that a
    constant property prunes folders, and constant subjects or objects prune files and row groups."""

    by_subject: DataFrame
    by_object: DataFrame

    def where(self, cond: Column) -> "Stored":
        return Stored(self.by_subject.where(cond), self.by_object.where(cond))

    def around(self, nodes: list[str]) -> DataFrame:
        """Edges from each of a few nodes, in both directions."""
        out = self.by_subject.where(F.col("s").isin(nodes)).select("s", "p", "o")
        back = self.by_object.where(F.col("o").isin(nodes))
        return out.unionByName(back.select(F.col("o").alias("s"), toggle(F.col("p")).alias("p"), F.col("s").alias("o")))


def save(tr: DataFrame, path: str) -> None:
    """Writes distinct triples as a ``Stored`` graph. Ranges go by all three columns, so that a hub lies in many files."""

    def write(name: str, *order: str) -> None:
        tr.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("p").mode("overwrite").parquet(f"{path}/{name}")

    together(lambda: write("subject", "p", "s", "o"), lambda: write("object", "p", "o", "s"))


def load(spark: SparkSession, path: str) -> Stored:
    one = lambda name: spark.read.schema("s string, o string, p string").parquet(f"{path}/{name}").select("s", "p", "o")
    return Stored(one("subject"), one("object"))


#: Stored graphs of this process, by folder and the times of change of its tables.
_STORED: dict[tuple, str] = {}
TABLES = ("customer", "supplier", "nation", "orders", "lineitem")


def stored_path(spark: SparkSession, d: str) -> str:
    """Folder of the graph of the warehouse tables, written to the shared folder the first time it is asked for."""
    key = (spark.sparkContext.applicationId, d, *[changed(spark, f"{d}/{name}.parquet") for name in TABLES])
    if key not in _STORED or not exists(spark, _STORED[key]):
        path = scratch(spark, "graph")
        save(cut(triples(spark, d)), path)
        _STORED[key] = path
    return _STORED[key]


def stored(spark: SparkSession, d: str) -> Stored:
    return load(spark, stored_path(spark, d))


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("n"))


def cap_degree(deg: DataFrame, max_links: int) -> DataFrame:
    return deg.where((F.col("n") > 0) & (F.col("n") < max_links))


# Dictionaries -------------------------------------------------------------------------------------------------------


def dictionary(terms: DataFrame, col: str, prefix: str = "u", partitions: int | None = None) -> DataFrame:
    """(col, code): codes number the distinct terms in their order, from 1.

    The terms are range-partitioned and numbered within each partition; only the partitions' sizes meet in one place.
    """
    spark = terms.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = terms.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(n, col).sortWithinPartitions(col)
    t = cut(t.select(col, F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("k")))
    sizes = sorted((r["part"], r["n"]) for r in t.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    base, rows = 0, []
    for part, size in sizes:
        rows.append((part, base))
        base += size
    bases = spark.createDataFrame(rows, "part int, base long")
    return t.join(F.broadcast(bases), "part").select(col, F.concat(F.lit(prefix), (F.col("base") + F.col("k") + 1).cast("string")).alias("code"))


def lookup(df: DataFrame, col: str, entries: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out`` from the dictionary ``entries``; null where it has no entry. Repeated keys must agree."""
    e = entries.select(F.col(key).alias(col), F.col(value).alias(out)).groupBy(col).agg(F.min(out).alias(out))
    return df.join(small(e), col, "left")


# Filters on entity documents (entity, p, value, ntype) --------------------------------------------------------------


def keep_properties(doc: DataFrame, ignored: DataFrame) -> DataFrame:
    """Properties that are URIs and not in ``ignored`` (one column p)."""
    return doc.where(F.col("p").startswith("http")).join(small(ignored), "p", "left_anti")


def keep_entities(doc: DataFrame, ignored: DataFrame, kb: KnowledgeBase = DBPEDIA) -> DataFrame:
    """Values that are entities of the knowledge base and not in ``ignored`` (one column value)."""
    return doc.where(F.col("value").startswith(kb.entity_prefix)).join(small(ignored), "value", "left_anti")


def keep_items(doc: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Values that are items of the knowledge base, by its pattern (``^Q`` for statement pages)."""
    return doc.where(F.col("value").rlike(kb.item_pattern))


def accept(terms: DataFrame, entries: DataFrame, ignored: DataFrame, kb: KnowledgeBase = DBPEDIA) -> DataFrame:
    """``terms`` (url, is_property, ntype) with ``ok`` and ``code``: whether a property or entity takes part, and under which code.

    A property is a URI, an entity one with the prefix of the knowledge base; neither may be in ``ignored`` (one column url).
    The code is that of ``entries`` (url, code), marked as inverse by the property's ntype; null where not accepted.
    """
    out = ignored.select("url", F.lit(True).alias("__out")).distinct()
    t = lookup(terms, "url", entries, "url", "code", "code").join(small(out), "url", "left")
    start = F.when(F.col("is_property"), F.col("url").startswith("http")).otherwise(F.col("url").startswith(kb.entity_prefix))
    ok = F.coalesce(start & F.col("__out").isNull() & F.col("code").isNotNull(), F.lit(False))
    marked = F.when(F.col("is_property") & (F.col("ntype") > kb.inverse_above), F.concat("code", F.lit("@"))).otherwise(F.col("code"))
    return t.select("url", "is_property", "ntype", ok.alias("ok"), F.when(ok, marked).alias("code"))


def append_values(lists: DataFrame, new: DataFrame, chunk: int = 1024) -> DataFrame:
    """(entity, p, chunk, values): the value lists of properties with the values of ``new`` (entity, p, value, seq) put at
    their ends, in the order of ``seq``; a list is made where there is none. ``lists`` (entity, p, chunk, values) may be empty.

    A list lies in chunks by ``seq`` (floor(seq / ``chunk``), so at most ``chunk`` values each if seq is unique), that a
    property with very many values fills no row; appended chunks follow the last of the list.
    """
    last = lists.groupBy("entity", "p").agg(F.max("chunk").alias("last"))
    add = new.groupBy("entity", "p", F.floor(F.col("seq") / chunk).alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("values"))
    base = add.groupBy("entity", "p").agg(F.min("at").alias("first"))
    added = add.join(base, ["entity", "p"]).join(last, ["entity", "p"], "left")
    return lists.select("entity", "p", "chunk", "values").unionByName(added.select("entity", "p", (F.col("at") - F.col("first") + F.coalesce(F.col("last") + 1, F.lit(0))).cast("long").alias("chunk"), "values"))


def tag_inverse(doc: DataFrame, kb: KnowledgeBase = DBPEDIA) -> DataFrame:
    return doc.withColumn("p", F.when(F.col("ntype") > kb.inverse_above, F.concat("p", F.lit("@"))).otherwise(F.col("p")))


def link_count(doc: DataFrame) -> DataFrame:
    return doc.groupBy("entity").agg(F.count_if(F.col("value").startswith("http://")).alias("n"))


def keep_first(df: DataFrame, key: str, value: str, order: str, default: str) -> DataFrame:
    """(key, value): the first non-null value of each key in the order given, ``default`` if there is none."""
    keyed = df.where(F.col(key).isNotNull())
    got = keyed.groupBy(key).agg(F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("f"))
    return got.select(key, F.coalesce("f.v", F.lit(default)).alias(value))


# Ranking ------------------------------------------------------------------------------------------------------------


#: Links of a node that go to one task.
HUB_LINKS = 500_000


def pagerank(tr: DataFrame, iterations: int = 3, damping: float = 0.85) -> DataFrame:
    """(node, score) after a fixed number of rounds from 1.0 for every node; scores of nodes without successors are not spread.

    The links are put in buckets by subject once, those of a hub in several (by a salt), and are not moved again; a round
    moves the scores of the nodes and the gains, which are added up where they arise before.
    """
    out_deg = tr.groupBy("s").agg(F.count(F.lit(1)).alias("d")).withColumn("salts", F.ceil(F.col("d") / HUB_LINKS).cast("int"))
    out_deg = cut(out_deg)
    links = bucketed(tr.join(out_deg, "s").select("s", F.pmod(F.xxhash64("o"), F.col("salts")).cast("int").alias("salt"), "o", "d"), "s", "salt")
    every = links.select(F.explode(F.array("s", "o")).alias("node")).distinct()
    nodes = bucketed(every.join(out_deg.select(F.col("s").alias("node"), "salts"), "node", "left"), "node")
    ranks = nodes.withColumn("score", F.lit(1.0))
    for _ in range(iterations):
        given = ranks.where("salts is not null").select(F.col("node").alias("s"), "score", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        gain = links.join(given, ["s", "salt"]).groupBy(F.col("o").alias("node")).agg(F.sum(F.col("score") / F.col("d")).alias("g"))
        ranks = nodes.join(gain, "node", "left").select("node", "salts", (F.lit(1 - damping) + damping * F.coalesce("g", F.lit(0.0))).alias("score"))
        ranks = cut(ranks)
    return ranks.select("node", "score")
