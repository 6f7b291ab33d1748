"""Classes of entities: candidates through an ontology, scores, the immediate class, domain tests.

The ontology (class, depth), its synonyms (name, class) and equivalents (class, eq) are catalogues that do not grow with
the data; they are broadcast only if their size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import count_literal
from ..sources.tables import small

DEFAULT = "Thing"


def candidates(types: DataFrame, synonyms: DataFrame, equivalents: DataFrame, depths: DataFrame) -> DataFrame:
    """(entity, class, depth): classes named by the entity's types, with their equivalents, that the ontology knows.

    ``types``: entity, name. Repeated types count once here.
    """
    direct = types.select("entity", "name").distinct().join(small(synonyms), "name").select("entity", "class")
    more = direct.join(small(equivalents), "class").select("entity", F.col("eq").alias("class"))
    return direct.unionByName(more).distinct().join(small(depths), "class").select("entity", "class", F.greatest("depth", F.lit(1)).alias("depth"))


def rank_classes(cands: DataFrame, facts: DataFrame) -> DataFrame:
    """(entity, class, score, rank) by score = (depth + 10 if the class is among the types) * frequency / number of types.

    Frequency is 1 up to depth 2, beyond it the number of times the class is named in the description, at least 1.
    ``facts``: entity, type_text (types joined by blanks), n_types, description. Equal scores: lower depth, then name.
    Entities of ``facts`` without any candidate get ``Thing`` with score 0.
    """
    j = facts.join(cands, "entity", "left")
    named = F.lower(F.col("class"))
    hit = F.when(F.coalesce(F.col("type_text"), F.lit("")).contains(F.col("class")), 10).otherwise(0)
    freq = F.when(F.col("depth") > 2, F.greatest(F.lit(1), F.coalesce(count_literal(F.lower("description"), named), F.lit(0)))).otherwise(F.lit(1))
    score = F.when(F.col("class").isNull(), 0.0).otherwise((F.col("depth") + hit) * freq / F.greatest("n_types", F.lit(1)))
    s = j.select("entity", F.coalesce("class", F.lit(DEFAULT)).alias("class"), "depth", score.cast("double").alias("score"))
    w = W.partitionBy("entity").orderBy(F.desc("score"), F.col("depth").asc_nulls_last(), "class")
    return s.withColumn("rank", F.row_number().over(w)).select("entity", "class", F.round("score", 6).alias("score"), "rank")


def immediate(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1").drop("rank")


def type_text(types: DataFrame) -> DataFrame:
    """(entity, type_text, n_types): types in order, joined by blanks."""
    return types.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("type_text"), F.count_distinct("name").alias("n_types"))


def class_mapping(types: DataFrame) -> DataFrame:
    return types.groupBy("name", "url").agg(F.count(F.lit(1)).alias("n"))


def in_domain(text: Column, keywords: tuple[str, ...]) -> Column:
    """True if the lower-cased text holds one of the keywords; null texts are outside."""
    low = F.lower(text)
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    return F.coalesce(hit, F.lit(False))
