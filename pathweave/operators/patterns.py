"""Path patterns (property sequences): instances, bindings, support, positions and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from . import paths as P

CODE = r"([A-Za-z]+[0-9]+@*)"


def pattern(path: Column) -> Column:
    return F.array_join(P.properties(path), " ")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE), F.lit(1))


def with_pattern(paths: DataFrame) -> DataFrame:
    return paths.withColumn("pattern", pattern(F.col("path"))).withColumn("size", F.col("len"))


def frequency(paths: DataFrame) -> DataFrame:
    """(pattern, size, instances)."""
    return with_pattern(paths).groupBy("pattern", "size").agg(F.count(F.lit(1)).alias("instances"))


def bindings(paths: DataFrame) -> DataFrame:
    """(pattern, pos, node): distinct nodes of each inner position (1 to size - 1)."""
    inner = F.expr("slice(nodes, 2, greatest(size(nodes) - 2, 0))")
    p = with_pattern(paths).withColumn("nodes", P.nodes(F.col("path")))
    return p.select("pattern", F.posexplode(inner).alias("k", "node")).select("pattern", (F.col("k") + 1).alias("pos"), "node").distinct()


def binding_counts(paths: DataFrame) -> DataFrame:
    return bindings(paths).groupBy("pattern", "pos").agg(F.count(F.lit(1)).alias("n"))


def min_support(paths: DataFrame) -> DataFrame:
    """(pattern, size, instances, min_support): the least number of distinct bindings of an inner position; 1 for single edges."""
    paths = cut(paths)  # read twice
    least = binding_counts(paths).groupBy("pattern").agg(F.min("n").alias("m"))
    return frequency(paths).join(least, "pattern", "left").select("pattern", "size", "instances", F.when(F.col("size") == 1, F.lit(1)).otherwise(F.col("m")).cast("long").alias("min_support"))


def compare_support(support: DataFrame) -> DataFrame:
    """(sub, super, sub_support, super_support): neighbouring parts of a pattern whose support is no more than the whole's.

    The parts of a pattern are listed (a pattern is short) and looked up by equality.
    """
    toks = F.split("pattern", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.transform(F.sequence(F.lit(1), F.size("t") - i + 1), lambda n: F.array_join(F.slice("t", i, n), " "))))
    whole = support.select(F.col("pattern").alias("super"), F.col("min_support").alias("super_support"), toks.alias("t"))
    part = whole.select("super", "super_support", F.explode(F.array_distinct(parts)).alias("sub")).where("sub <> super")
    return part.join(support.select(F.col("pattern").alias("sub"), F.col("min_support").alias("sub_support")), "sub").where("sub_support <= super_support").select("sub", "super", "sub_support", "super_support")


def ranked(freq: DataFrame, top: int) -> DataFrame:
    """(pattern, size, instances, rank) of the ``top`` most frequent patterns; equal ones in the order of their text."""
    best = freq.orderBy(F.desc("instances"), "pattern").limit(top)
    return best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("instances"), "pattern")))


def pages(freq: DataFrame, percent: int = 10) -> DataFrame:
    """(pattern, size, instances, rank, page): all patterns in the order of their frequency (equal ones by their text), in
    pages of ``percent`` of the list, at least one pattern each; rank and page from 1.

    The list is range-partitioned and numbered within its partitions; only the partitions' sizes meet in one place.
    """
    n = int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("instances"), F.col("pattern")]
    t = freq.repartitionByRange(n, *order).sortWithinPartitions(*order)
    t = cut(t.select("pattern", "size", "instances", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("k")))
    sizes = sorted((r["part"], r["n"]) for r in t.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    base, rows = 0, []
    for part, size in sizes:
        rows.append((part, base))
        base += size
    page = max(1, (base + 1) * percent // 100)
    out = t.join(F.broadcast(t.sparkSession.createDataFrame(rows, "part int, base long")), "part").withColumn("rank", F.col("base") + F.col("k") + 1)
    return out.select("pattern", "size", "instances", "rank", (F.floor((F.col("rank") - 1) / page) + 1).alias("page"))


def positions(freq: DataFrame) -> DataFrame:
    """(pattern, size, prop, pos), pos from 1."""
    return freq.select("pattern", "size", F.posexplode(F.split("pattern", " ")).alias("k", "prop")).select("pattern", "size", "prop", (F.col("k") + 1).alias("pos"))


def overlap(pairs: DataFrame, freq: DataFrame) -> DataFrame:
    """(pattern_a, pos_a, pattern_b, pos_b): where the patterns of a pair share a property and may be joined.

    Two end positions must be the same end; an end and an inner position do not combine; inner positions do.
    """
    at = positions(freq)
    a = at.select(F.col("pattern").alias("pattern_a"), F.col("size").alias("size_a"), "prop", F.col("pos").alias("pos_a"))
    b = at.select(F.col("pattern").alias("pattern_b"), F.col("size").alias("size_b"), "prop", F.col("pos").alias("pos_b"))
    return _joinable(pairs.join(a, "pattern_a").join(b, ["pattern_b", "prop"]))


def _joinable(m: DataFrame) -> DataFrame:
    first_a, first_b = F.col("pos_a") == 1, F.col("pos_b") == 1
    last_a, last_b = F.col("pos_a") == F.col("size_a"), F.col("pos_b") == F.col("size_b")
    ends_a, ends_b = first_a | last_a, first_b | last_b
    return m.where((first_a & first_b) | (last_a & last_b) | (~ends_a & ~ends_b)).select("pattern_a", "pos_a", "pattern_b", "pos_b")


def _two(freq: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Patterns of more than one property as a and as b, and the condition that a is the more frequent; equal ones in the order of their text."""
    t = freq.where("size > 1")
    a, b = (t.select(*(F.col(c).alias(f"{c}_{x}") for c in ("pattern", "size", "instances"))) for x in "ab")
    return a, b, (F.col("instances_a") > F.col("instances_b")) | ((F.col("instances_a") == F.col("instances_b")) & (F.col("pattern_a") < F.col("pattern_b")))


def all_pairs(freq: DataFrame) -> DataFrame:
    """(pattern_a, pattern_b) of all patterns of more than one property, the more frequent first."""
    a, b, before = _two(freq)
    return a.join(b, before).select("pattern_a", "pattern_b")


def all_overlap(freq: DataFrame) -> DataFrame:
    """``overlap`` of ``all_pairs``, by an equi-join on the property; the pairs are not formed."""
    a, b, before = _two(freq)
    a, b = (t.select("*", F.posexplode(F.split(f"pattern_{x}", " ")).alias(f"k_{x}", f"prop_{x}")).withColumn(f"pos_{x}", F.col(f"k_{x}") + 1) for t, x in ((a, "a"), (b, "b")))
    return _joinable(a.join(b, (F.col("prop_a") == F.col("prop_b")) & before))


def entity_pairs(paths: DataFrame) -> DataFrame:
    """(pattern, start, end): the pairs of endpoints that show each pattern."""
    return with_pattern(paths).select("pattern", F.element_at("path", 1).alias("start"), F.element_at("path", -1).alias("end")).distinct()


def merged_pattern(paths: DataFrame) -> DataFrame:
    """(pair_id, merged): the distinct patterns between a pair, in order, joined by `` | ``."""
    return with_pattern(paths).groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_set("pattern")), " | ").alias("merged"))


def complex_bindings(paths: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(pair_id, pos, n): distinct bindings of all patterns between the same endpoints together, by position from the start.

    ``stored`` (merged, pos, node): bindings kept for merged patterns measured before; where the merged pattern of a pair is
    known they stand for it, else the bindings of its paths are united.
    """
    inner = F.expr("slice(nodes, 2, greatest(size(nodes) - 2, 0))")
    p = paths.withColumn("nodes", P.nodes(F.col("path")))
    b = p.select("pair_id", F.posexplode(inner).alias("k", "node")).select("pair_id", (F.col("k") + 1).alias("pos"), "node")
    if stored is not None:
        merged = merged_pattern(paths)
        known = merged.join(stored.select("merged").distinct(), "merged", "left_semi")
        b = b.join(known, "pair_id", "left_anti").unionByName(known.join(stored, "merged").select("pair_id", "pos", "node"))
    return b.distinct().groupBy("pair_id", "pos").agg(F.count(F.lit(1)).alias("n"))
