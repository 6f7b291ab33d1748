"""Cardinalities of triple patterns around the members of paths, set at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import small


def count_by(triples: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys..., n): triples of each wanted key, 0 where there is none."""
    n = triples.join(small(wanted), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def grouping_sets(triples: DataFrame) -> DataFrame:
    """(kind, key, n) of the five shapes in one pass."""
    g = triples.groupingSets([["s"], ["p"], ["o"], ["s", "p"], ["p", "o"]], "s", "p", "o").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    kind = F.concat(*[F.when(F.col("gid").bitwiseAND(bit) == 0, F.lit(c)).otherwise("") for c, bit in (("s", 4), ("p", 2), ("o", 1))])
    return g.select(kind.alias("kind"), F.concat_ws(" ", "s", "p", "o").alias("key"), "n")


def property_pair_counts(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p1, p2, n): matches of ``?s p1 ?o . ?o p2 ?x``. The walks are never formed: their number is the sum over the middle
    node of the products of its counts. ``pairs``: p1, p2."""
    into = adj.join(small(pairs.select(F.col("p1").alias("p")).distinct()), "p", "left_semi").groupBy(F.col("o").alias("m"), F.col("p").alias("p1")).agg(F.count(F.lit(1)).alias("a"))
    out = adj.join(small(pairs.select(F.col("p2").alias("p")).distinct()), "p", "left_semi").groupBy(F.col("s").alias("m"), F.col("p").alias("p2")).agg(F.count(F.lit(1)).alias("b"))
    n = into.join(out, "m").groupBy("p1", "p2").agg(F.sum(F.col("a") * F.col("b")).alias("n"))
    return pairs.join(n, ["p1", "p2"], "left").select("p1", "p2", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
