"""Queries p2 to p4: nested documents, skewed keys, rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, skew
from ..sources import badrows
from ..sources.tables import table

HEAVY_SHARE = 0.03


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    flat = nested.flat_statements(nested.dewey_nodes(table(spark, d, "xmlparser"), "record_id", "property"), "record_id")
    return flat.select("record_id", "flat_prop", "stmt_no", "qual_no").distinct()


def _p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.dewey_nodes(table(spark, d, "xmlparser"), "record_id", "property")


def p2_properties(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_table(_p2_nodes(spark, d), nested.STATEMENT_DOCUMENT.path, {"property": "property", "name": "name", "ntype": "ntype"}).distinct()


def p2_statements(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_table(_p2_nodes(spark, d), nested.STATEMENTS.path, {"url": "url", "value": "value", "rank": "rank"}).distinct()


def p2_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_table(_p2_nodes(spark, d), nested.QUALIFIERS.path, {"property": "property", "name": "name", "url": "url", "value": "value"}).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    fields = {"client6380.size": table(spark, d, "client6380").select("size"), "l_wobject_extend.sequence": table(spark, d, "l_wobject_extend").select("sequence")}
    return skew.heavy_keys(fields, HEAVY_SHARE).select("field", "key_value")


def p3_wobject_keys(spark: SparkSession, d: str) -> DataFrame:
    out = skew.key_profile(table(spark, d, "l_wobject_extend"), "sequence", "node")
    return out.select(F.col("key").alias("sequence"), "n_rows", F.col("n_entities").alias("n_nodes"))


def p3_client_keys(spark: SparkSession, d: str) -> DataFrame:
    out = skew.key_profile(table(spark, d, "client6380"), "size", "code")
    return out.select(F.col("key").alias("size"), "n_rows", F.col("n_entities").alias("n_codes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "sparql").select("line_id", "header", "texto")
    return badrows.load_records(src).where(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def p4_good(spark: SparkSession, d: str) -> DataFrame:
    """The valid records: a row per field."""
    src = table(spark, d, "sparql").select("line_id", "header", "texto")
    good = badrows.load_records(src).where(F.col("reason").isNull())
    return good.select("line_id", F.explode("fields").alias("variable", "value")).distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_properties, p2_statements, p2_qualifiers, p3_found, p3_wobject_keys, p3_client_keys, p4_found, p4_good)}

SPLIT = r"""
t AS (SELECT DISTINCT line_id, header, texto, CASE WHEN ends_with(texto, chr(13) || chr(10)) THEN left(texto, length(texto) - 2)
        WHEN right(texto, 1) IN (chr(13), chr(10)) THEN left(texto, length(texto) - 1) ELSE texto END AS r FROM sparql),
u AS (SELECT *, coalesce(trim(texto, ' ' || chr(9) || chr(10) || chr(13)) = '', true) OR header IS NULL AS blank,
        regexp_full_match(r, '(?s)(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*') AS splits,
        list_transform(string_split(header, ','), lambda h: trim(h)) AS names,
        list_transform(regexp_extract_all(',' || r, '(?s),("(?:[^"]|"")*"|[^",\r\n]*)', 1),
          lambda f: CASE WHEN starts_with(f, '"') THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) AS vals FROM t),
e AS (SELECT line_id, unnest(names) AS variable, unnest(vals) AS value FROM u WHERE NOT blank AND splits AND len(names) = len(vals)),
bad AS (SELECT DISTINCT line_id FROM e WHERE NOT CASE
        WHEN variable IN ('s', 'p', 'e1', 'e2', 'class') THEN regexp_full_match(value, '(?s)https?://[^\s<>"]+')
        WHEN variable = 'n' THEN regexp_full_match(value, '[0-9]+')
        WHEN variable = 'score' THEN regexp_full_match(value, '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')
        WHEN variable = 'd' THEN regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(value AS date) IS NOT NULL
        ELSE true END)
"""

#: Nested documents by JSON functions: entries, statements and qualifiers with their ordinals, every shape made a list first.
NESTED = """
d AS (SELECT DISTINCT record_id, property::JSON AS j FROM xmlparser WHERE property IS NOT NULL AND json_valid(property)),
e AS (SELECT record_id, k, json_extract(j, '$."' || k || '"') AS b, n FROM (SELECT record_id, j, unnest(json_keys(j)) AS k, generate_subscripts(json_keys(j), 1) AS n FROM d WHERE json_type(j) = 'OBJECT')
  UNION ALL SELECT record_id, b ->> 'property', b, n FROM (SELECT record_id, unnest(j::JSON[]) AS b, generate_subscripts(j::JSON[], 1) AS n FROM d WHERE json_type(j) = 'ARRAY')),
l0 AS (SELECT record_id, k, n, upper(trim(k)) AS p, CASE WHEN json_type(b -> 'list_statement') = 'VARCHAR' THEN (b ->> 'list_statement')::JSON ELSE b -> 'list_statement' END AS l FROM e),
l1 AS (SELECT record_id, p, n, CASE json_type(l) WHEN 'ARRAY' THEN l::JSON[] WHEN 'OBJECT' THEN [l] END AS l FROM l0),
st AS (SELECT record_id, p, n, unnest(l) AS st, generate_subscripts(l, 1) AS stmt_no FROM l1 WHERE len(l) > 0),
q0 AS (SELECT *, CASE json_type(st -> 'list') WHEN 'ARRAY' THEN (st -> 'list')::JSON[] WHEN 'OBJECT' THEN [st -> 'list'] END AS ql FROM st),
q1 AS (SELECT record_id, p, n, stmt_no, unnest(ql) AS q, generate_subscripts(ql, 1) AS qual_no FROM q0 WHERE len(ql) > 0),
q2 AS (SELECT *, json_type(q) = 'ARRAY' AS arr, json_array_length(q) AS len FROM q1),
q3 AS (SELECT record_id, p, n, stmt_no, qual_no, arr, len, q, CASE WHEN arr THEN q ->> 0 ELSE q ->> 'property' END AS code, CASE WHEN arr THEN q ->> 1 ELSE q ->> 'name' END AS name,
  CASE WHEN NOT arr THEN q ->> 'url' WHEN len >= 4 THEN q ->> 2 END AS url, CASE WHEN NOT arr THEN q ->> 'value' WHEN len >= 4 THEN q ->> 3 WHEN len = 3 THEN q ->> 2 END AS value FROM q2)
"""

SQL = {
    "p2_found": "WITH " + NESTED + """
        SELECT DISTINCT record_id, 'p:' || p || '/ps:' || p AS flat_prop, stmt_no, 0 AS qual_no FROM st WHERE p <> '' AND (coalesce(st ->> 'url', '') <> '' OR coalesce(st ->> 'value', '') <> '')
        UNION SELECT record_id, 'p:' || p || '/pq:' || upper(trim(code)), stmt_no, qual_no FROM q3 WHERE p <> '' AND coalesce(trim(code), '') <> '' AND (coalesce(url, '') <> '' OR coalesce(value, '') <> '')""",
    "p2_properties": "WITH " + NESTED + " SELECT DISTINCT record_id, n::varchar AS dewey, NULL::varchar AS parent_dewey, n AS ordinal, k AS property, b ->> 'name' AS name, b ->> 'ntype' AS ntype FROM e",
    "p2_statements": "WITH " + NESTED + " SELECT DISTINCT record_id, n || '.' || stmt_no AS dewey, n::varchar AS parent_dewey, stmt_no AS ordinal, st ->> 'url' AS url, st ->> 'value' AS value, st ->> 'rank' AS rank FROM st",
    "p2_qualifiers": "WITH " + NESTED + " SELECT DISTINCT record_id, n || '.' || stmt_no || '.' || qual_no AS dewey, n || '.' || stmt_no AS parent_dewey, qual_no AS ordinal, code AS property, name, url, value FROM q3",
    "p3_found": """
        WITH k AS (SELECT 'client6380.size' AS field, size::varchar AS key_value, count(*) AS n FROM client6380 WHERE size IS NOT NULL GROUP BY 2
          UNION ALL SELECT 'l_wobject_extend.sequence', sequence::varchar, count(*) FROM l_wobject_extend WHERE sequence IS NOT NULL GROUP BY 2)
        SELECT field, key_value FROM (SELECT *, sum(n) OVER (PARTITION BY field) AS total FROM k) WHERE n >= 0.03 * total""",
    "p3_wobject_keys": "SELECT sequence, count(*) AS n_rows, count(DISTINCT node) AS n_nodes FROM l_wobject_extend WHERE sequence IS NOT NULL GROUP BY 1",
    "p3_client_keys": "SELECT size, count(*) AS n_rows, count(DISTINCT code) AS n_codes FROM client6380 WHERE size IS NOT NULL GROUP BY 1",
    "p4_found": "WITH " + SPLIT + """
        SELECT line_id, CASE WHEN texto IS NULL OR header IS NULL THEN 'column_count' WHEN NOT splits THEN 'quoting' WHEN blank OR len(names) <> len(vals) THEN 'column_count' ELSE 'invalid_value' END AS reason
        FROM u WHERE blank OR NOT splits OR len(names) <> len(vals) OR line_id IN (SELECT line_id FROM bad)""",
    "p4_good": "WITH " + SPLIT + " SELECT DISTINCT line_id, variable, value FROM e WHERE line_id NOT IN (SELECT line_id FROM bad)",
}
