"""Queries p1 and p5 to p9, with SQL where it can say the same over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import leaks, ledger, mixture, pii, stripes, subsequences

MIN_SHARE, MIN_COUNT = 0.02, 5
RUN = 12
#: Levels of significance of the pairs found and of the pairs reported.
FOUND_LEVEL, PAIRS_LEVEL = 0.05, 0.001


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    a = subsequences.from_lists(table(spark, d, "intersection_paths"), "inter_id", "list_properties", "intersection_paths")
    b = subsequences.from_text(table(spark, d, "pattern_tool"), "pattern_id", "freq_pattern", "pattern_tool")
    return a.unionByName(b)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    closed = subsequences.closed_patterns(_sequences(spark, d), MIN_SHARE, MIN_COUNT)
    return subsequences.recover(closed, 3, 5).select("origin", "pattern")


def p1_supports(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of two properties and more with the number of sequences that hold them."""
    closed = subsequences.closed_patterns(_sequences(spark, d), MIN_SHARE, MIN_COUNT)
    return subsequences.recover(closed, 2, 5)


def p1_closed(spark: SparkSession, d: str) -> DataFrame:
    closed = subsequences.closed_patterns(_sequences(spark, d), MIN_SHARE, MIN_COUNT)
    return closed.select("origin", F.array_join("pattern", " ").alias("pattern"), "support")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return stripes.cooccurrence(stripes.records(table(spark, d, "hcorr_prop"), "corr_id", "list_properties"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that are frequent, three times as frequent as by chance, and significantly so.

    The conditions on counts make G2 at least 2 (n_ab ln 3 - 2/3 n_ab) >= 4.3, so the test at ``FOUND_LEVEL`` (3.84) holds
    for each of them; ``p5_pairs`` tests pairs of any lift, where it decides.
    """
    frequent = (F.col("n_ab") >= 5) & (F.col("n_ab") * 500 >= F.col("n")) & (F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b"))
    return _pairs(spark, d).where(frequent & stripes.significant(FOUND_LEVEL)).select(F.col("a").alias("prop_a"), F.col("b").alias("prop_b"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that stand together in five records and significantly (at ``PAIRS_LEVEL``) more often than by chance."""
    g = F.round(stripes.log_likelihood(), 3)
    return _pairs(spark, d).where((F.col("n_ab") >= 5) & stripes.significant(PAIRS_LEVEL)).select(F.col("a").alias("prop_a"), F.col("b").alias("prop_b"), "n_ab", "n_a", "n_b", F.round(stripes.lift(), 4).alias("lift"), g.alias("llr"))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hobjects").select(F.col("obj_id").alias("id"), ledger.text_key("sequence", "object").alias("key"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hlist_paths").select(F.col("path_id").alias("id"), ledger.text_key("sequence", "string_path").alias("key"))


ORIGINS = {"hobjects": _objects, "hlist_paths": _paths}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [ledger.repeats(rows(spark, d)).select(F.lit(o).alias("origin"), F.col("id").alias("row_id")) for o, rows in ORIGINS.items()])


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [ledger.audit(rows(spark, d)).select(F.lit(o).alias("origin"), "*") for o, rows in ORIGINS.items()])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "benchmark"), run=RUN)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Each document that holds evaluation text: how many items, which, and the longest run of words."""
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), run=RUN)
    return found.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items"), F.max("n_words").alias("longest_run"))


def p7_too_short(spark: SparkSession, d: str) -> DataFrame:
    """Items of fewer words than a run, which cannot be found."""
    return leaks.too_short(table(spark, d, "benchmark"), run=RUN)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), table(spark, d, "members")).select("doc_id", "kind", "found_text").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), table(spark, d, "members"))


QUERIES = {f.__name__: f for f in (p1_found, p1_supports, p1_closed, p5_found, p5_pairs, p6_found, p6_report, p7_found, p7_report, p7_too_short, p8_mixture, p8_report, p9_found, p9_redacted)}

_CLEAN = "upper(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)))"
_SEQS = f"""
raw AS (SELECT 'intersection_paths' AS origin, inter_id AS id, list_filter(list_transform(list_properties, lambda x: {_CLEAN.format('x')}), lambda x: x IS NOT NULL AND x <> '') AS seq FROM intersection_paths
  UNION ALL SELECT 'pattern_tool', pattern_id, list_filter(list_transform(regexp_split_to_array(freq_pattern, '\\s+'), lambda x: {_CLEAN.format('x')}), lambda x: x IS NOT NULL AND x <> '') FROM pattern_tool),
s AS (SELECT origin, id, any_value(seq) AS seq FROM raw WHERE len(seq) > 0 GROUP BY 1, 2),
least AS (SELECT origin, greatest(5, ceil(count(*) / 50.0)) AS m FROM s GROUP BY 1),
el AS (SELECT origin, id, unnest(seq) AS x, generate_subscripts(seq, 1) AS pos FROM s),
ok AS (SELECT origin, x FROM el JOIN least USING (origin) GROUP BY origin, x, m HAVING count(DISTINCT id) >= m),
e AS (SELECT el.* FROM el JOIN ok USING (origin, x)),
p2 AS (SELECT a.origin, a.id, a.x || ' ' || b.x AS p, b.pos AS pos FROM e a JOIN e b ON a.origin = b.origin AND a.id = b.id AND a.pos < b.pos),
p3 AS (SELECT a.origin, a.id, a.p || ' ' || b.x AS p, b.pos AS pos FROM p2 a JOIN e b ON a.origin = b.origin AND a.id = b.id AND a.pos < b.pos),
p4 AS (SELECT a.origin, a.id, a.p || ' ' || b.x AS p, b.pos AS pos FROM p3 a JOIN e b ON a.origin = b.origin AND a.id = b.id AND a.pos < b.pos),
p5 AS (SELECT a.origin, a.id, a.p || ' ' || b.x AS p, b.pos AS pos FROM p4 a JOIN e b ON a.origin = b.origin AND a.id = b.id AND a.pos < b.pos),
n AS (SELECT origin, p AS pattern, count(DISTINCT id) AS support FROM ({{}}) JOIN least USING (origin) GROUP BY origin, p, m HAVING count(DISTINCT id) >= m)
"""
_PAIRS = f"""
r AS (SELECT DISTINCT corr_id AS id, unnest(list_distinct(list_filter(list_transform(list_properties, lambda x: {_CLEAN.format('x')}), lambda x: x IS NOT NULL AND x <> ''))) AS x FROM hcorr_prop),
n AS (SELECT count(DISTINCT id) AS n FROM r), one AS (SELECT x, count(*) AS c FROM r GROUP BY 1),
ab AS (SELECT a.x AS prop_a, b.x AS prop_b, count(*) AS n_ab FROM r a JOIN r b ON a.id = b.id AND a.x < b.x GROUP BY 1, 2),
w AS (SELECT prop_a, prop_b, n_ab, p.c AS n_a, q.c AS n_b, n, n_ab::double AS k11, (p.c - n_ab)::double AS k12, (q.c - n_ab)::double AS k21, (n - p.c - q.c + n_ab)::double AS k22
  FROM ab JOIN one p ON p.x = prop_a JOIN one q ON q.x = prop_b CROSS JOIN n)
"""
_WHITE = "'[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+'"
_KEYS = " UNION ALL ".join(
    f"SELECT '{o}' AS origin, {i} AS row_id, sequence, nullif(trim(regexp_replace({c}, {_WHITE}, ' ', 'g')), '') AS k FROM {o}" for o, i, c in (("hobjects", "obj_id", "object"), ("hlist_paths", "path_id", "string_path"))
)
_WORDS = r"list_filter(regexp_split_to_array(replace(lower(strip_accents(regexp_replace(text, '([\p{L}\p{N}])-[ \t]*\r?\n\s*([\p{L}\p{N}])', '\1\2', 'g'))), 'ß', 'ss'), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '')"
_RUNS = f"""
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ir AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
"""

SQL = {
    "p1_found": "WITH " + _SEQS.format("FROM p3 UNION ALL FROM p4 UNION ALL FROM p5") + " SELECT origin, pattern FROM n",
    "p1_supports": "WITH " + _SEQS.format("FROM p2 UNION ALL FROM p3 UNION ALL FROM p4 UNION ALL FROM p5") + " SELECT origin, pattern, support FROM n",
    # a pattern is closed if none with one more property has its support; patterns of six are counted only to judge those of five, there are no longer ones
    "p1_closed": "WITH " + _SEQS.replace("n AS (SELECT", "p6 AS (SELECT a.origin, a.id, a.p || ' ' || b.x AS p, b.pos AS pos FROM p5 a JOIN e b ON a.origin = b.origin AND a.id = b.id AND a.pos < b.pos),\nn AS (SELECT").format(
        "SELECT origin, id, x AS p FROM e UNION ALL SELECT origin, id, p FROM p2 UNION ALL SELECT origin, id, p FROM p3 UNION ALL SELECT origin, id, p FROM p4 UNION ALL SELECT origin, id, p FROM p5 UNION ALL SELECT origin, id, p FROM p6")
    + """, t AS (SELECT *, string_split(pattern, ' ') AS w FROM n), less AS (SELECT origin, support, w, unnest(range(1, len(w) + 1)) AS j FROM t),
        part AS (SELECT DISTINCT origin, support, array_to_string(list_concat(w[1 : j - 1], w[j + 1 :]), ' ') AS pattern FROM less)
        SELECT origin, pattern, support FROM n ANTI JOIN part USING (origin, pattern, support)""",
    "p5_found": "WITH " + _PAIRS + " SELECT prop_a, prop_b FROM w WHERE n_ab >= 5 AND n_ab * 500 >= n AND n_ab * n >= 3 * n_a * n_b",
    "p5_pairs": "WITH " + _PAIRS + """, g AS (SELECT *, 2 * (k11 * ln(k11 * n / (n_a * n_b::double)) + CASE WHEN k12 > 0 THEN k12 * ln(k12 * n / (n_a * (n - n_b)::double)) ELSE 0 END
          + CASE WHEN k21 > 0 THEN k21 * ln(k21 * n / ((n - n_a) * n_b::double)) ELSE 0 END + CASE WHEN k22 > 0 THEN k22 * ln(k22 * n / ((n - n_a) * (n - n_b)::double)) ELSE 0 END) AS g2 FROM w)
        SELECT prop_a, prop_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b)::double, 4) AS lift, round(g2, 3) AS llr FROM g WHERE n_ab >= 5 AND n_ab * n >= n_a * n_b AND g2 > 10.827566170662733""",
    "p6_found": f"SELECT origin, row_id FROM (SELECT *, min(row_id) OVER (PARTITION BY origin, sequence, k) AS f FROM ({_KEYS}) WHERE k IS NOT NULL) WHERE row_id > f",
    "p6_report": f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY origin, sequence, k ORDER BY row_id) AS nth FROM ({_KEYS})),
        f AS (SELECT origin, sequence, k, min(row_id) AS first_id FROM k WHERE k IS NOT NULL GROUP BY 1, 2, 3),
        j AS (SELECT k.*, CASE WHEN k.k IS NOT NULL THEN nth > 1 END AS seen, k.row_id > first_id AS later FROM k LEFT JOIN f ON f.origin = k.origin AND f.sequence IS NOT DISTINCT FROM k.sequence AND f.k = k.k)
        SELECT origin, count(*) AS n_rows, count(*) FILTER (k IS NULL) AS n_null, count(*) FILTER (NOT seen) AS n_new, count(*) FILTER (seen) AS n_repeat,
        count(*) FILTER (seen <> later) AS n_wrong, count(*) FILTER (seen <> later) / count(*)::double AS wrong_rate FROM j GROUP BY 1""",
    "p7_report": "WITH " + _RUNS.replace("dr AS (SELECT DISTINCT doc_id, ", "dr AS (SELECT doc_id, k, ") + """,
        hit AS (SELECT DISTINCT doc_id, item_id, k FROM dr JOIN ir USING (r)), isl AS (SELECT doc_id, item_id, k - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k) AS g FROM hit),
        run AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM isl GROUP BY doc_id, item_id, g)
        SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items, max(n) AS longest_run FROM run GROUP BY 1""",
    "p7_too_short": f"SELECT DISTINCT item_id, len({_WORDS})::int AS n_words FROM benchmark WHERE len({_WORDS}) < 12",
    "p7_found": "WITH " + _RUNS + " SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (r)",
}
