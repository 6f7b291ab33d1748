"""Views of paths (arrays of alternating codes): edges, reversal, properties, patterns, objects, meta-paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import toggle


def text(path: Column) -> Column:
    return F.array_join(path, " ")


def nodes(path: Column) -> Column:
    return F.filter(path, lambda x, i: i % 2 == 0)


def properties(path: Column) -> Column:
    return F.filter(path, lambda x, i: i % 2 == 1)


def is_simple(path: Column) -> Column:
    n = nodes(path)
    return F.size(F.array_distinct(n)) == F.size(n)


def reverse(path: Column) -> Column:
    return F.transform(F.reverse(path), lambda x, i: F.when(i % 2 == 1, toggle(x)).otherwise(x))


def arrows(path: Column) -> Column:
    """Array of (s, p, o); empty for a path of one node."""
    n = F.floor((F.size(path) - 1) / 2).cast("int")
    at = lambda k: F.get(path, k)
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.struct(at(2 * i).alias("s"), at(2 * i + 1).alias("p"), at(2 * i + 2).alias("o")))


def path_edges(paths: DataFrame) -> DataFrame:
    """(pair_id, path, pos, s, p, o), pos from 1."""
    return paths.select("pair_id", "path", F.posexplode(arrows(F.col("path"))).alias("pos", "e")).select("pair_id", "path", (F.col("pos") + 1).alias("pos"), "e.s", "e.p", "e.o")


def stored(s: Column, p: Column, o: Column) -> list[Column]:
    """The triple behind an arrow: an inverse arrow is stored the other way round."""
    inv = p.endswith("@")
    return [F.when(inv, o).otherwise(s).alias("s"), F.regexp_replace(p, "@$", "").alias("p"), F.when(inv, s).otherwise(o).alias("o")]


def objects(paths: DataFrame) -> DataFrame:
    return paths.select(F.explode(nodes(F.col("path"))).alias("node")).distinct()


def graph(paths: DataFrame) -> DataFrame:
    return path_edges(paths).select("s", "p", "o").distinct()


def property_pairs(paths: DataFrame) -> DataFrame:
    """Unordered pairs of different properties of one path: distinct (pa, pb), the smaller first. A path is short, so its pairs are few."""
    p = paths.select(F.array_sort(F.array_distinct(properties(F.col("path")))).alias("ps")).distinct()
    pa = p.select("ps", F.posexplode("ps").alias("i", "pa"))
    return pa.select("pa", F.explode(F.expr("slice(ps, i + 2, size(ps))")).alias("pb")).distinct()


def meta_paths(paths: DataFrame, classes: DataFrame, default: str = "Thing") -> DataFrame:
    """(pair_id, path, meta): nodes replaced by their class. ``classes``: node, class."""
    e = paths.select("pair_id", "path", F.posexplode("path").alias("i", "x"))
    c = e.join(classes.select(F.col("node").alias("x"), "class"), "x", "left")
    word = F.when(F.col("i") % 2 == 1, F.col("x")).otherwise(F.coalesce("class", F.lit(default)))
    seq = F.transform(F.array_sort(F.collect_list(F.struct("i", word.alias("w")))), lambda z: z["w"])
    return c.groupBy("pair_id", "path").agg(F.array_join(seq, " ").alias("meta"))


def splits(paths: DataFrame, most: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, node, left_part, right_part): every inner node as a meeting of two parts of at most ``most`` edges."""
    at = paths.select("path", *carry, F.posexplode("path").alias("i", "node")).where("i % 2 = 0 and i > 0 and i < size(path) - 1")
    parts = at.select("path", "node", "i", *carry, F.expr("slice(path, 1, i + 1)").alias("left_part"), F.expr("slice(path, i + 1, size(path))").alias("right_part"))
    return parts.where((F.size("left_part") <= 2 * most + 1) & (F.size("right_part") <= 2 * most + 1))


def shared_classes(paths: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(path, node, common): classes of nodes on both sides of a meeting node, without it, in order and joined by commas."""
    meta = meta_paths(paths, classes).select("path", F.split("meta", " ").alias("m"))
    s = splits(paths.join(meta, "path"), most, ("m",))
    left = nodes(F.expr("slice(m, 1, i)"))
    right = nodes(F.expr("slice(m, i + 3, size(m))"))
    common = F.array_sort(F.array_distinct(F.array_intersect(left, right)))
    return s.select("path", "node", F.array_join(common, ",").alias("common")).where("common <> ''")
