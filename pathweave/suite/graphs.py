"""Queries on triples, dictionaries, filters, search, paths, cardinalities, patterns and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..operators import canonical, graph, patterns, paths, search, stats
from ..session import scratch
from ..sources.tables import table
from ..streaming import incremental
from .sqltext import ADJ, ARROWS, DEGREE, PATTERNS, TRIPLES, found, walk

FLAG = [("c0", "s1")]
#: pairs over which patterns are mined, at up to three edges
PAIRS = [("c0", "s1"), ("c0", "p0"), ("o1", "p0"), ("p0", "p1"), ("o1", "s1")]
MAX_LINKS = 50
TOP = 50
RESOURCE, PROPERTY = "http://dbpedia.org/resource/", "http://kb.example/property/"

_E = graph.stored


def _flag(s: SparkSession, d: str) -> DataFrame:
    return search.find_paths(search.pairs_of(s, FLAG), _E(s, d), SearchConfig(length=4, max_links=None))


def _mined(s: SparkSession, d: str) -> DataFrame:
    return search.find_paths(search.pairs_of(s, PAIRS), _E(s, d), SearchConfig(length=3, max_links=None))


def _side(s: SparkSession, d: str, side: str, levels: int, pairs=FLAG) -> DataFrame:
    return search.one_side(search.pairs_of(s, pairs), _E(s, d), side, levels, SearchConfig(max_links=None))


def _text(df: DataFrame) -> DataFrame:
    return df.select(paths.text(F.col("path")).alias("path"), F.col("len"))


def document(s: SparkSession, d: str) -> DataFrame:
    """(entity, p, value, ntype): entity documents of customers, suppliers, nations and orders, with literals and inverse rows."""
    e = graph.edges(s, d).where("p in ('P1', 'P2', 'P3')")
    prop = F.concat(F.lit(PROPERTY), "p")
    fwd = e.select(F.col("s").alias("entity"), prop.alias("p"), F.concat(F.lit(RESOURCE), "o").alias("value"), F.lit(1).alias("ntype"))
    back = e.where("p <> 'P3'").select(F.col("o").alias("entity"), prop.alias("p"), F.concat(F.lit(RESOURCE), "s").alias("value"), F.lit(4).alias("ntype"))
    cust = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), F.explode(F.array(F.struct(F.lit(PROPERTY + "name").alias("p"), F.col("c_name").alias("value")), F.struct(F.lit("label").alias("p"), F.col("c_mktsegment").alias("value")))).alias("e"))
    return fwd.unionByName(back).unionByName(cust.select("entity", "e.p", "e.value", F.lit(1).alias("ntype")))


DOC = f"""doc AS (SELECT s AS entity, '{PROPERTY}' || p AS p, '{RESOURCE}' || o AS value, 1 AS ntype FROM triples WHERE p IN ('P1', 'P2', 'P3')
  UNION ALL SELECT o, '{PROPERTY}' || p, '{RESOURCE}' || s, 4 FROM triples WHERE p IN ('P1', 'P2')
  UNION ALL SELECT 'c' || c_custkey, '{PROPERTY}name', c_name, 1 FROM customer UNION ALL SELECT 'c' || c_custkey, 'label', c_mktsegment, 1 FROM customer)"""

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


# Graph --------------------------------------------------------------------------------------------------------------


@query(f"WITH {TRIPLES} SELECT s, p, o FROM triples")
def triples_build(s, d):
    return graph.triples(s, d)


@query(f"WITH {ADJ} SELECT s, p, o FROM adj")
def adjacency(s, d):
    return graph.adjacency(s, d)


@query(f"WITH {DEGREE} SELECT node, n FROM degree")
def degree(s, d):
    return graph.degree(graph.with_inverse(graph.stored(s, d).by_subject))


@query(f"WITH {DEGREE} SELECT node, n FROM degree WHERE n > 0 AND n < {MAX_LINKS}")
def degree_cap(s, d):
    return graph.cap_degree(graph.degree(graph.with_inverse(graph.stored(s, d).by_subject)), MAX_LINKS)


@query("SELECT url, 'u' || dense_rank() OVER (ORDER BY url) AS code FROM (SELECT DISTINCT url FROM client6380 WHERE url IS NOT NULL)")
def dict_encode(s, d):
    return graph.dictionary(table(s, d, "client6380"), "url")


@query("WITH e AS (SELECT code, min(url) AS url FROM client6380 GROUP BY 1) SELECT obj_id, o.code, url FROM (SELECT obj_id, trim(object, ' ' || chr(9) || chr(10) || chr(13)) AS code FROM hobjects) o LEFT JOIN e ON o.code = e.code")
def dict_decode(s, d):
    objs = table(s, d, "hobjects").select("obj_id", F.regexp_replace("object", r"^\s+|\s+$", "").alias("code"))
    return graph.lookup(objs, "code", table(s, d, "client6380"), "code", "url", "url").select("obj_id", "code", "url")


@query(f"WITH {TRIPLES}, {DOC} SELECT entity, count(*) FILTER (starts_with(value, 'http://')) AS n FROM doc GROUP BY 1")
def link_count(s, d):
    return graph.link_count(document(s, d))


@query(f"WITH {TRIPLES}, {DOC} SELECT entity, p, value FROM doc WHERE starts_with(p, 'http') AND p NOT IN ('{PROPERTY}P2')")
def filter_property(s, d):
    return graph.keep_properties(document(s, d), s.createDataFrame([(PROPERTY + "P2",)], "p string")).select("entity", "p", "value")


@query(f"WITH {TRIPLES}, {DOC} SELECT entity, p, value FROM doc WHERE starts_with(value, '{RESOURCE}') AND value NOT IN ('{RESOURCE}n0', '{RESOURCE}c0')")
def filter_entity(s, d):
    return graph.keep_entities(document(s, d), s.createDataFrame([(RESOURCE + "n0",), (RESOURCE + "c0",)], "value string")).select("entity", "p", "value")


@query(f"WITH {TRIPLES}, {DOC} SELECT entity, p || CASE WHEN ntype > 2 THEN '@' ELSE '' END AS p, value FROM doc")
def inverse_tag(s, d):
    return graph.tag_inverse(document(s, d)).select("entity", "p", "value")


_TERMS = f"""terms AS (SELECT DISTINCT p AS url, true AS is_property, ntype FROM doc UNION SELECT value, false, ntype FROM doc), codes AS (SELECT url, 'u' || dense_rank() OVER (ORDER BY url) AS code FROM (SELECT DISTINCT url FROM terms WHERE starts_with(url, 'http'))),
ok AS (SELECT terms.*, CASE WHEN is_property THEN starts_with(url, 'http') ELSE starts_with(url, '{RESOURCE}') END AND url NOT IN ('{PROPERTY}P2', '{RESOURCE}n0') AS ok FROM terms)"""


@query(f"WITH {TRIPLES}, {DOC}, {_TERMS} SELECT url, is_property, ntype, ok, CASE WHEN ok THEN code || CASE WHEN is_property AND ntype > 2 THEN '@' ELSE '' END END AS code FROM ok LEFT JOIN codes USING (url)")
def predicate_dispatch(s, d):
    """Properties and entities of the documents: whether they take part, and their codes."""
    doc = document(s, d)
    terms = doc.select(F.col("p").alias("url"), F.lit(True).alias("is_property"), "ntype").unionByName(doc.select(F.col("value").alias("url"), F.lit(False).alias("is_property"), "ntype")).distinct()
    codes = graph.dictionary(terms.where(F.col("url").startswith("http")), "url")
    return graph.accept(terms, codes, s.createDataFrame([(PROPERTY + "P2",), (RESOURCE + "n0",)], "url string"))


@query("""SELECT 'c' || o_custkey AS entity, 'P3@' AS p, (o_orderkey // 512 - first)::bigint AS chunk, array_to_string(list('o' || o_orderkey ORDER BY o_orderkey), ' ') AS list
    FROM orders JOIN (SELECT o_custkey, min(o_orderkey // 512) AS first FROM orders GROUP BY 1) USING (o_custkey) GROUP BY o_custkey, o_orderkey // 512, first""")
def append_to_property(s, d):
    """Orders put at the end of their customers' lists."""
    new = table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"), F.lit("P3@").alias("p"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("value"), F.col("o_orderkey").alias("seq"))
    none = s.createDataFrame([], "entity string, p string, chunk long, values array<string>")
    return graph.append_values(none, new, 512).select("entity", "p", "chunk", F.array_join("values", " ").alias("list"))


@query(f"WITH {TRIPLES} SELECT s, p, o FROM triples WHERE p NOT IN ('P4', 'P5')")
def ignore_anti(s, d):
    return graph.triples(s, d).join(F.broadcast(s.createDataFrame([("P4",), ("P5",)], "p string")), "p", "left_anti").select("s", "p", "o")


@query("""SELECT code, coalesce(arg_min(description, (cached_at, description)) FILTER (description IS NOT NULL), 'No label defined') AS description FROM client6380 WHERE code IS NOT NULL GROUP BY 1""")
def keep_first(s, d):
    return graph.keep_first(table(s, d, "client6380"), "code", "description", "cached_at", "No label defined")


# Search -------------------------------------------------------------------------------------------------------------

_FLAG = "WITH " + found(FLAG, 4)
_MINED = "WITH " + found(PAIRS, 3)


@query(f"WITH {ADJ} SELECT s, p, o FROM adj WHERE s = 'c0'")
def frontier_expand(s, d):
    one = _side(s, d, "L", 1).where("depth = 1")
    return one.select(F.get("path", F.lit(0)).alias("s"), F.get("path", F.lit(1)).alias("p"), F.get("path", F.lit(2)).alias("o"))


@query(f"WITH {ADJ}, {walk('w', 'c0', 2, 's1')} SELECT path, len FROM w")
def left_paths(s, d):
    return _side(s, d, "L", 2).select(paths.text(F.col("path")).alias("path"), F.col("depth").alias("len"))


@query(
    f"""WITH {ADJ}, {walk('w', 's1', 2, 'c0')}
    SELECT array_to_string(list_transform(range(len(x), 0, -1), lambda k: CASE WHEN k % 2 = 1 THEN x[k] WHEN ends_with(x[k], '@') THEN left(x[k], length(x[k]) - 1) ELSE x[k] || '@' END), ' ') AS path, len
    FROM (SELECT string_split(path, ' ') AS x, len FROM w)"""
)
def right_paths(s, d):
    return _side(s, d, "R", 2).select(paths.text(F.col("path")).alias("path"), F.col("depth").alias("len"))


_BOTH = f"WITH {ADJ}, {walk('l', 'c0', 2, 's1')}, {walk('r', 's1', 2, 'c0')}"


@query(_BOTH + " SELECT DISTINCT node FROM l WHERE node IN (SELECT node FROM r)")
def meet_nodes(s, d):
    return search.meet_nodes(_side(s, d, "L", 2), _side(s, d, "R", 2)).select("node")


@query(_BOTH + " SELECT node FROM l INTERSECT SELECT node FROM r")
def side_intersect(s, d):
    return _side(s, d, "L", 2).select("node").intersect(_side(s, d, "R", 2).select("node"))


@query(_BOTH + " SELECT DISTINCT node FROM l WHERE node IN (SELECT node FROM r) AND node NOT IN (SELECT node FROM l WHERE len < 2 INTERSECT SELECT node FROM r WHERE len < 2)")
def new_meet_nodes(s, d):
    now = search.meet_nodes(_side(s, d, "L", 2), _side(s, d, "R", 2)).select("node")
    return search.new_nodes(now, search.meet_nodes(_side(s, d, "L", 1), _side(s, d, "R", 1)).select("node"))


@query(_FLAG + " SELECT path, len FROM paths")
def relatedness_paths(s, d):
    return _text(_flag(s, d))


@query(f"WITH {ADJ}, {walk('w', 'c0', 2)} SELECT path, len FROM w WHERE len > 0")
def simple_paths(s, d):
    return _side(s, d, "L", 2, [("c0", "none")]).where("depth > 0").select(paths.text(F.col("path")).alias("path"), F.col("depth").alias("len"))


@query("WITH " + found([("c0", "s1"), ("s1", "c0")], 3) + " SELECT DISTINCT least(path, array_to_string(list_transform(range(len(x), 0, -1), lambda k: CASE WHEN k % 2 = 1 THEN x[k] WHEN ends_with(x[k], '@') THEN left(x[k], length(x[k]) - 1) ELSE x[k] || '@' END), ' ')) AS path FROM (SELECT path, string_split(path, ' ') AS x FROM paths)")
def path_dedup(s, d):
    """Paths found in both directions, each once."""
    p = search.find_paths(search.pairs_of(s, [("c0", "s1"), ("s1", "c0")]), _E(s, d), SearchConfig(length=3, max_links=None))
    return p.select(F.least(paths.text(F.col("path")), paths.text(paths.reverse(F.col("path")))).alias("path")).distinct()


@query("WITH " + found([("s0", "s1")], 2) + " SELECT path, len FROM paths")
def relatedness_s0_s1_l2(s, d):
    return _text(search.find_paths(search.pairs_of(s, [("s0", "s1")]), _E(s, d), SearchConfig(length=2, max_links=None)))


@query(f"""WITH {DEGREE}, ok AS (SELECT node FROM degree WHERE n < {MAX_LINKS}), one AS (SELECT p, o FROM adj WHERE s = 'c0' AND o <> 'c0')
    SELECT 'c0 ' || one.p || ' ' || one.o || ' ' || a.p || ' ' || a.o AS path, 2 AS len FROM one JOIN ok ON ok.node = one.o JOIN adj a ON a.s = one.o WHERE a.o <> 'c0' UNION ALL SELECT 'c0 ' || p || ' ' || o, 1 FROM one""")
def capped_paths(s, d):
    """Two levels from c0 that do not pass through nodes of many links."""
    p = search.one_side(search.pairs_of(s, [("c0", "none")]), _E(s, d), "L", 2, SearchConfig(max_links=MAX_LINKS))
    return p.where("depth > 0").select(paths.text(F.col("path")).alias("path"), F.col("depth").alias("len"))


#: nodes of the graph that may be entered, and that have a class: by their number
GATES = """gate AS (SELECT DISTINCT x AS node, regexp_extract(x, '[0-9]+')::bigint AS k FROM (SELECT s AS x FROM triples UNION SELECT o FROM triples)),
domain AS (SELECT node FROM gate WHERE k % 3 <> 1 OR node IN ('c0', 's1')), classed AS (SELECT node FROM gate WHERE k % 5 <> 2)"""


def _gates(s, d) -> tuple[DataFrame, DataFrame]:
    nodes = graph.stored(s, d).by_subject.select(F.explode(F.array("s", "o")).alias("node")).distinct()
    k = F.regexp_extract("node", "[0-9]+", 0).cast("long")
    return nodes.where((k % 3 != 1) | F.col("node").isin("c0", "s1")), nodes.where(k % 5 != 2)


@query(_FLAG + f", {GATES} SELECT path, len FROM paths, (SELECT list(node) AS ok FROM domain) WHERE len(list_filter(nodes[2 :], lambda x: NOT list_contains(ok, x))) = 0")
def domain_paths(s, d):
    """Paths that enter only nodes of the domain."""
    return _text(search.find_paths(search.pairs_of(s, FLAG), _E(s, d), SearchConfig(length=4, max_links=None), domain=_gates(s, d)[0]))


@query(_FLAG + f", {GATES} SELECT path, len FROM paths, (SELECT list(node) AS ok FROM classed) WHERE len(list_filter(nodes, lambda x: NOT list_contains(ok, x))) = 0")
def classed_paths(s, d):
    """Paths all of whose nodes have a class."""
    return _text(search.find_paths(search.pairs_of(s, FLAG), _E(s, d), SearchConfig(length=4, max_links=None), classed=_gates(s, d)[1]))


@query(f"""WITH {ADJ}, {walk('l', 'c0', 2, 's1')}, {walk('r', 's1', 2, 'c0')}, m0 AS (SELECT node FROM l WHERE len < 1 INTERSECT SELECT node FROM r WHERE len < 1), m1 AS (SELECT node FROM l WHERE len < 2 INTERSECT SELECT node FROM r WHERE len < 2),
    m2 AS (SELECT node FROM l INTERSECT SELECT node FROM r) SELECT node, 1 AS round FROM m1 WHERE node NOT IN (SELECT node FROM m0) UNION ALL SELECT node, 2 FROM m2 WHERE node NOT IN (SELECT node FROM m1)""")
def last_round(s, d):
    """Meet nodes of the last level, and those of the extra round after it."""
    return search.last_round(search.pairs_of(s, FLAG), _E(s, d), SearchConfig(length=2, max_links=None)).select("node", "round")


# Views of paths -----------------------------------------------------------------------------------------------------


@query(_FLAG + ARROWS + " SELECT path, pos, s, p, o FROM arrows")
def path_edges(s, d):
    return paths.path_edges(_flag(s, d)).select(paths.text(F.col("path")).alias("path"), "pos", "s", "p", "o")


@query(_FLAG + " SELECT path, array_to_string(list_transform(range(len(x), 0, -1), lambda k: CASE WHEN k % 2 = 1 THEN x[k] WHEN ends_with(x[k], '@') THEN left(x[k], length(x[k]) - 1) ELSE x[k] || '@' END), ' ') AS reversed FROM (SELECT path, string_split(path, ' ') AS x FROM paths)")
def path_reverse(s, d):
    p = _flag(s, d)
    return p.select(paths.text(F.col("path")).alias("path"), paths.text(paths.reverse(F.col("path"))).alias("reversed"))


@query(_FLAG + PATTERNS + " SELECT path, pattern AS properties, true AS simple FROM pats")
def path_properties(s, d):
    p = _flag(s, d)
    return p.select(paths.text(F.col("path")).alias("path"), F.array_join(paths.properties(F.col("path")), " ").alias("properties"), paths.is_simple(F.col("path")).alias("simple"))


@query(_FLAG + PATTERNS + " SELECT DISTINCT pattern, len AS size FROM pats")
def path_pattern(s, d):
    return patterns.with_pattern(_flag(s, d)).select("pattern", "size").distinct()


@query(_FLAG + " SELECT DISTINCT unnest(nodes) AS node FROM paths")
def path_objects(s, d):
    return paths.objects(_flag(s, d))


@query(_FLAG + ARROWS + " SELECT DISTINCT s, p, o FROM arrows")
def path_graph(s, d):
    return paths.graph(_flag(s, d))


@query(_MINED + ARROWS + " SELECT DISTINCT a.p AS pa, b.p AS pb FROM arrows a JOIN arrows b ON a.pair_id = b.pair_id AND a.path = b.path AND a.p < b.p")
def property_pairs(s, d):
    return paths.property_pairs(_mined(s, d))


@query(_FLAG + """, cls AS (SELECT 'c' || c_custkey AS node, c_mktsegment AS class FROM customer UNION ALL SELECT 'p' || p_partkey, p_type FROM part)
    SELECT path, array_to_string(list_transform(range(1, len(x) + 1), lambda k: CASE WHEN k % 2 = 0 THEN x[k] ELSE coalesce(m[x[k]], 'Thing') END), ' ') AS meta
    FROM (SELECT path, string_split(path, ' ') AS x FROM paths), (SELECT map_from_entries(list((node, class))) AS m FROM cls)""")
def meta_paths(s, d):
    return paths.meta_paths(_flag(s, d), _classes(s, d)).select(paths.text(F.col("path")).alias("path"), "meta")


_CLASSES = """, cls AS (SELECT 'c' || c_custkey AS node, c_mktsegment AS class FROM customer UNION ALL SELECT 'p' || p_partkey, p_type FROM part),
x AS (SELECT path, string_split(path, ' ') AS w, list_transform(range(1, len(w) + 1), lambda k: CASE WHEN k % 2 = 0 THEN w[k] ELSE coalesce(m[w[k]], 'Thing') END) AS c
  FROM (SELECT path, string_split(path, ' ') AS w FROM paths), (SELECT map_from_entries(list((node, class))) AS m FROM cls)),
cutat AS (SELECT path, w, c, unnest(list_filter(range(1, len(w) + 1), lambda k: k % 2 = 1 AND k > 1 AND k < len(w))) AS k FROM x)"""


def _classes(s, d) -> DataFrame:
    cust = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("class"))
    return cust.unionByName(table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_type").alias("class")))


@query(_FLAG + _CLASSES + " SELECT w[k] AS node, array_to_string(w[1 : k], ' ') AS left_part, array_to_string(w[k :], ' ') AS right_part FROM cutat WHERE k <= 5 AND len(w) - k < 5")
def path_splits(s, d):
    """Every inner node of a found path as a meeting of a left and a right part of at most two edges."""
    return paths.splits(_flag(s, d), 2).select("node", paths.text(F.col("left_part")).alias("left_part"), paths.text(F.col("right_part")).alias("right_part"))


@query(_FLAG + _CLASSES + """, v AS (SELECT w[k] AS node, path, list_filter(c[1 : k - 1], lambda y, j: j % 2 = 1) AS l, list_filter(c[k + 1 :], lambda y, j: j % 2 = 0) AS r FROM cutat WHERE k <= 5 AND len(w) - k < 5)
    SELECT node, path, array_to_string(list_sort(list_distinct(list_intersect(l, r))), ',') AS common FROM v WHERE len(list_intersect(l, r)) > 0""")
def meta_path_common(s, d):
    """Vertices that the meta-paths of the two parts share besides the meeting node."""
    return paths.shared_classes(_flag(s, d), _classes(s, d), 2).select("node", paths.text(F.col("path")).alias("path"), "common")


@query("""SELECT DISTINCT sequence, level, node, side FROM (SELECT sequence, level, node, upper(trim(side)) AS side FROM l_wobject_extend) WHERE sequence IS NOT NULL AND level IS NOT NULL AND side IN ('L', 'R')""")
def frontier_insert(s, d):
    """First-seen nodes of each level and side of the stored frontiers."""
    f = table(s, d, "l_wobject_extend").select("sequence", "level", "node", F.upper(F.trim("side")).alias("side"))
    return f.where("sequence is not null and level is not null and side in ('L', 'R')").dropDuplicates(["sequence", "level", "node", "side"])


@query(_FLAG + ARROWS + " SELECT path, arg_max(o, pos) AS last_node, max(pos) AS n FROM arrows GROUP BY path")
def serialised_paths(s, d):
    """Arrows written as JSON and read back."""
    p = _flag(s, d).withColumn("json", F.to_json(paths.arrows(F.col("path"))))
    back = p.withColumn("back", F.from_json("json", "array<struct<s:string,p:string,o:string>>"))
    return back.withColumn("path", paths.text(F.col("path"))).select("path", F.element_at("back", -1)["o"].alias("last_node"), F.size("back").alias("n"))


# Cardinalities ------------------------------------------------------------------------------------------------------

_KEYS = _FLAG + ARROWS + """, st AS (SELECT DISTINCT CASE WHEN ends_with(p, '@') THEN o ELSE s END AS s, rtrim(p, '@') AS p, CASE WHEN ends_with(p, '@') THEN s ELSE o END AS o FROM arrows),
node AS (SELECT DISTINCT unnest(nodes) AS x FROM paths)"""


def _members(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = _flag(s, d)
    e = paths.path_edges(p)
    return graph.stored(s, d).by_subject, paths.objects(p), e.select(*paths.stored(F.col("s"), F.col("p"), F.col("o"))).distinct()


@query(_KEYS + " SELECT x AS key, (SELECT count(*) FROM triples t WHERE t.s = x) AS n FROM node")
def stats_s(s, d):
    t, n, _ = _members(s, d)
    return stats.count_by(t, ["s"], n.select(F.col("node").alias("s"))).select(F.col("s").alias("key"), "n")


@query(_KEYS + " SELECT x AS key, (SELECT count(*) FROM triples t WHERE t.o = x) AS n FROM node")
def stats_o(s, d):
    t, n, _ = _members(s, d)
    return stats.count_by(t, ["o"], n.select(F.col("node").alias("o"))).select(F.col("o").alias("key"), "n")


@query(_KEYS + " SELECT p AS key, count(*) AS n FROM triples WHERE p IN (SELECT p FROM st) GROUP BY 1")
def stats_p(s, d):
    t, _, e = _members(s, d)
    return stats.count_by(t, ["p"], e.select("p").distinct()).select(F.col("p").alias("key"), "n")


@query(_KEYS + " SELECT s || ' ' || p AS key, count(*) AS n FROM triples WHERE (s, p) IN (SELECT (s, p) FROM st) GROUP BY 1")
def stats_sp(s, d):
    t, _, e = _members(s, d)
    return stats.count_by(t, ["s", "p"], e.select("s", "p").distinct()).select(F.concat_ws(" ", "s", "p").alias("key"), "n")


@query(_KEYS + " SELECT p || ' ' || o AS key, count(*) AS n FROM triples WHERE (p, o) IN (SELECT (p, o) FROM st) GROUP BY 1")
def stats_po(s, d):
    t, _, e = _members(s, d)
    return stats.count_by(t, ["p", "o"], e.select("p", "o").distinct()).select(F.concat_ws(" ", "p", "o").alias("key"), "n")


@query(f"""WITH {TRIPLES} SELECT 's' AS kind, s AS key, count(*) AS n FROM triples GROUP BY 2 UNION ALL SELECT 'p', p, count(*) FROM triples GROUP BY 2 UNION ALL SELECT 'o', o, count(*) FROM triples GROUP BY 2
    UNION ALL SELECT 'sp', s || ' ' || p, count(*) FROM triples GROUP BY 2 UNION ALL SELECT 'po', p || ' ' || o, count(*) FROM triples GROUP BY 2""")
def stats_grouping_sets(s, d):
    return stats.grouping_sets(graph.stored(s, d).by_subject)


@query(f"""WITH {TRIPLES} SELECT 's' AS kind, s AS key, count(*) AS n FROM triples GROUP BY 2 UNION ALL SELECT 'p', p, count(*) FROM triples GROUP BY 2 UNION ALL SELECT 'o', o, count(*) FROM triples GROUP BY 2
    UNION ALL SELECT 'sp', s || ' ' || p, count(*) FROM triples GROUP BY 2 UNION ALL SELECT 'po', p || ' ' || o, count(*) FROM triples GROUP BY 2""")
def streamed_counts(s, d):
    """The same counts kept up to date by a stream that has read all triples."""
    out = scratch(s, "streamed")
    source = s.readStream.schema("s string, o string, p string").parquet(graph.stored_path(s, d) + "/subject")
    incremental.start(source.select("s", "p", "o"), out, scratch(s, "progress")).awaitTermination()
    return incremental.current(s, out)


@query(f"WITH {ADJ} SELECT a.p || ',' || b.p AS key, count(*) AS n FROM adj a JOIN adj b ON a.o = b.s WHERE (a.p, b.p) IN (('P3@', 'P4'), ('P1', 'P1@'), ('P3', 'P1'), ('P2@', 'P1@'), ('P2', 'P2@')) GROUP BY 1")
def property_pair_count(s, d):
    pairs = s.createDataFrame([("P3@", "P4"), ("P1", "P1@"), ("P3", "P1"), ("P2@", "P1@"), ("P2", "P2@")], "p1 string, p2 string")
    return stats.property_pair_counts(graph.with_inverse(graph.stored(s, d).by_subject), pairs).select(F.concat_ws(",", "p1", "p2").alias("key"), "n")


# Patterns -----------------------------------------------------------------------------------------------------------


@query(_MINED + PATTERNS + " SELECT pattern, size, instances FROM freq")
def pattern_frequency(s, d):
    return patterns.frequency(_mined(s, d))


@query(_MINED + PATTERNS + f" SELECT pattern, instances, row_number() OVER (ORDER BY instances DESC, pattern) AS rank FROM freq QUALIFY rank <= {TOP}")
def patterns_ranked(s, d):
    return patterns.ranked(patterns.frequency(_mined(s, d)), TOP).select("pattern", "instances", "rank")


_TOOL = """tool AS (SELECT array_to_string(regexp_extract_all(upper(freq_pattern), '[A-Z]+[0-9]+@*'), ' ') AS pattern, coalesce(max(instances), 0) AS instances FROM pattern_tool WHERE freq_pattern IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_TOOL}, r AS (SELECT *, row_number() OVER (ORDER BY instances DESC, pattern) AS rank, count(*) OVER () AS n FROM tool WHERE pattern <> '') SELECT pattern, instances, rank, (rank - 1) // greatest(1, (n + 1) * 10 // 100) + 1 AS page FROM r")
def pattern_pages(s, d):
    """All stored patterns by frequency, in pages of a tenth of the list."""
    t = table(s, d, "pattern_tool").where("freq_pattern is not null").select(F.array_join(patterns.tokens(F.upper("freq_pattern")), " ").alias("pattern"), "instances").where("pattern <> ''")
    freq = t.groupBy("pattern").agg(F.coalesce(F.max("instances"), F.lit(0)).alias("instances")).withColumn("size", F.size(F.split("pattern", " ")))
    return patterns.pages(freq).select("pattern", "instances", "rank", "page")


@query(_MINED + PATTERNS + " SELECT pattern, pos, n FROM bcount")
def pattern_bindings(s, d):
    return patterns.binding_counts(_mined(s, d))


@query(_MINED + PATTERNS + " SELECT pattern, size, instances, min_support FROM supp")
def pattern_min_support(s, d):
    return patterns.min_support(_mined(s, d))


@query(_MINED + PATTERNS + " SELECT a.pattern AS sub, b.pattern AS super, a.min_support AS sub_support, b.min_support AS super_support FROM supp a JOIN supp b ON a.pattern <> b.pattern AND contains(' ' || b.pattern || ' ', ' ' || a.pattern || ' ') WHERE a.min_support <= b.min_support")
def pattern_compare(s, d):
    return patterns.compare_support(patterns.min_support(_mined(s, d)))


_RANKED = _MINED + PATTERNS + ", rk AS (SELECT pattern, size, row_number() OVER (ORDER BY instances DESC, pattern) AS rank FROM freq)"
_PAGE = _RANKED + ", pp AS (SELECT a.pattern AS pattern_a, b.pattern AS pattern_b FROM rk a JOIN rk b ON a.rank < b.rank WHERE a.size > 1 AND b.size > 1)"


@query(_PAGE + " SELECT pattern_a, pattern_b FROM pp")
def pattern_pairs(s, d):
    return patterns.all_pairs(patterns.frequency(_mined(s, d)))


@query(_MINED + PATTERNS + " SELECT pattern, size, prop, pos FROM (SELECT pattern, size, unnest(string_split(pattern, ' ')) AS prop, unnest(range(1, size + 1)) AS pos FROM freq)")
def pattern_positions(s, d):
    return patterns.positions(patterns.frequency(_mined(s, d)))


@query("SELECT pattern_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT pattern_id, regexp_extract_all(freq_pattern, '([A-Za-z]+[0-9]+@*)', 1) AS t FROM pattern_tool)")
def pattern_tokens(s, d):
    t = table(s, d, "pattern_tool").select("pattern_id", F.posexplode(patterns.tokens(F.col("freq_pattern"))).alias("k", "token"))
    return t.select("pattern_id", "token", (F.col("k") + 1).alias("pos"))


@query(_PAGE + """, ps AS (SELECT pattern, size, unnest(string_split(pattern, ' ')) AS prop, unnest(range(1, size + 1)) AS pos FROM freq)
    SELECT pattern_a, a.pos AS pos_a, pattern_b, b.pos AS pos_b FROM pp JOIN ps a ON a.pattern = pattern_a JOIN ps b ON b.pattern = pattern_b AND a.prop = b.prop
    WHERE (a.pos = 1 AND b.pos = 1) OR (a.pos = a.size AND b.pos = b.size) OR (a.pos NOT IN (1, a.size) AND b.pos NOT IN (1, b.size))""")
def pattern_overlap(s, d):
    return patterns.all_overlap(patterns.frequency(_mined(s, d)))


@query(_MINED + ARROWS + " SELECT pair_id, pos, count(DISTINCT o) AS n FROM arrows WHERE pos < len GROUP BY 1, 2")
def complex_bindings(s, d):
    return patterns.complex_bindings(_mined(s, d))


@query(_MINED + ARROWS + """, mp AS (SELECT pair_id, string_agg(DISTINCT pat, ' | ' ORDER BY pat) AS merged FROM (SELECT pair_id, path, string_agg(p, ' ' ORDER BY pos) AS pat FROM arrows GROUP BY 1, 2) GROUP BY 1),
    stored AS (SELECT merged, 1 AS pos, 'x' || k AS node FROM mp, range(0, 7) t(k) WHERE pair_id = 'c0-s1' UNION ALL SELECT merged, 2, 'y' FROM mp WHERE pair_id = 'c0-s1')
    SELECT pair_id, pos, count(DISTINCT node) AS n FROM (SELECT pair_id, pos, o AS node FROM arrows JOIN mp USING (pair_id) WHERE pos < len AND merged NOT IN (SELECT merged FROM stored) UNION ALL SELECT pair_id, pos, node FROM mp JOIN stored USING (merged)) GROUP BY 1, 2""")
def complex_stored(s, d):
    """Bindings of merged patterns where one of them has been measured before."""
    mined = _mined(s, d)
    known = patterns.merged_pattern(mined).where("pair_id = 'c0-s1'").select("merged")
    at = F.explode(F.array(*[F.struct(F.lit(1).alias("pos"), F.lit(f"x{k}").alias("node")) for k in range(7)], F.struct(F.lit(2).alias("pos"), F.lit("y").alias("node"))))
    return patterns.complex_bindings(mined, known.select("merged", at.alias("e")).select("merged", "e.pos", "e.node"))


@query(_MINED + PATTERNS + " SELECT DISTINCT pattern, nodes[1] AS start, nodes[-1] AS \"end\" FROM pats JOIN paths USING (pair_id, path)")
def pattern_pairs_of_entities(s, d):
    return patterns.entity_pairs(_mined(s, d))


def _canonical(s, d, what):
    e = paths.path_edges(search.find_paths(search.pairs_of(s, PAIRS), _E(s, d), SearchConfig(length=3, max_links=None)))
    return what(e.select("pair_id", "s", "p", "o"), search.pairs_of(s, PAIRS))


#: Depth first from the start: the first arrow waiting is taken; arrows of a node met for the first time are put before those that wait. Nodes are numbered as they are met.
_DFS = """WITH RECURSIVE """ + _MINED.removeprefix("WITH ") + ARROWS + """, e AS MATERIALIZED (SELECT DISTINCT pair_id, s, p, o FROM arrows),
most AS (SELECT pair_id, count(DISTINCT s) AS m FROM e GROUP BY 1),
lv AS (SELECT DISTINCT pair_id, o AS root, 0 AS depth, o AS node FROM e UNION ALL SELECT DISTINCT lv.pair_id, root, depth + 1, e.o FROM lv JOIN e ON e.pair_id = lv.pair_id AND e.s = node JOIN most ON most.pair_id = lv.pair_id WHERE depth < m),
walks AS (SELECT pair_id, root, list(labels ORDER BY depth) AS w FROM (SELECT lv.pair_id, root, depth, list(p ORDER BY p) AS labels FROM lv JOIN e ON e.pair_id = lv.pair_id AND e.s = node GROUP BY 1, 2, 3) GROUP BY 1, 2),
out_of AS MATERIALIZED (SELECT e.pair_id, s AS node, list({{'s': s, 'p': p, 'o': o}} ORDER BY {}) AS arrows FROM e LEFT JOIN walks ON walks.pair_id = e.pair_id AND root = o GROUP BY 1, 2),
dfs AS (SELECT pair_id, arrows AS waiting, [node] AS seen, arrows[1 : 0] AS done FROM out_of WHERE node = split_part(pair_id, '-', 1)
  UNION ALL SELECT d.pair_id, CASE WHEN list_contains(seen, waiting[1].o) OR a.arrows IS NULL THEN waiting[2 :] ELSE list_concat(a.arrows, waiting[2 :]) END,
    CASE WHEN list_contains(seen, waiting[1].o) THEN seen ELSE list_append(seen, waiting[1].o) END, list_append(done, waiting[1]) FROM dfs d LEFT JOIN out_of a ON a.pair_id = d.pair_id AND a.node = d.waiting[1].o WHERE len(waiting) > 0)"""


@query(_DFS.format("p, o") + " SELECT pair_id, array_to_string(list_transform(done, lambda x: x.s || ',' || x.p || ',' || x.o || ','), '') AS graph FROM dfs WHERE len(waiting) = 0")
def graph_canonical(s, d):
    return _canonical(s, d, canonical.canonical).select("pair_id", "graph")


@query(_DFS.format("p, coalesce(w, []), o") + """ SELECT pair_id, array_to_string(list_transform(done, lambda x: list_position(seen, x.s) || ',' || x.p || ',' || list_position(seen, x.o) || ','), '')
    || '@' || coalesce(list_position(seen, split_part(pair_id, '-', 2)), 0) AS pattern FROM dfs WHERE len(waiting) = 0""")
def pattern_canonical(s, d):
    return _canonical(s, d, canonical.canonical).select("pair_id", "pattern")


@query(_DFS.format("p, coalesce(w, []), o") + " SELECT pair_id, unnest(range(1, len(seen) + 1)) AS variable, unnest(seen) AS node FROM dfs WHERE len(waiting) = 0")
def pattern_variables(s, d):
    """The node that each variable of the canonical pattern stands for."""
    return _canonical(s, d, canonical.variables).select("pair_id", F.col("variable").cast("long").alias("variable"), "node")


# Ranking ------------------------------------------------------------------------------------------------------------

_PR = [f"{TRIPLES}, od AS (SELECT s, count(*) AS d FROM triples GROUP BY 1), nd AS (SELECT s AS node FROM triples UNION SELECT o FROM triples), r0 AS (SELECT node, 1.0::double AS score FROM nd)"]
for _k in (1, 2, 3):
    _PR.append(f"r{_k} AS (SELECT nd.node, 0.15::double + 0.85::double * coalesce(g, 0) AS score FROM nd LEFT JOIN (SELECT o AS node, sum(score / d) AS g FROM triples JOIN od USING (s) JOIN r{_k - 1} ON node = s GROUP BY 1) USING (node))")
_RANK = ", ".join(_PR)


@query(f"WITH {_RANK} SELECT node, round(score + 1e-9, 4) AS score FROM r3")
def pagerank_3(s, d):
    return graph.pagerank(graph.stored(s, d).by_subject).select("node", F.round(F.col("score") + 1e-9, 4).alias("score"))


@query(f"WITH {_RANK}, adj AS (SELECT s, p, o FROM triples UNION ALL SELECT o, p || '@', s FROM triples), {walk('l', 'c0', 2, 's1')}, {walk('b', 's1', 2, 'c0')}, m AS (SELECT DISTINCT node FROM l WHERE node IN (SELECT node FROM b)) SELECT node, round(score + 1e-9, 4) AS score, row_number() OVER (ORDER BY round(score + 1e-9, 4) DESC, node) AS rank FROM m JOIN r3 USING (node) QUALIFY rank <= {TOP}")
def meet_nodes_ranked(s, d):
    met = search.meet_nodes(_side(s, d, "L", 2), _side(s, d, "R", 2)).select("node")
    best = met.join(graph.pagerank(graph.stored(s, d).by_subject), "node").select("node", F.round(F.col("score") + 1e-9, 4).alias("score")).orderBy(F.desc("score"), "node").limit(TOP)
    return best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "node")))


QUERIES, SQL = Q, S
