"""Queries on classes, basic graph patterns, texts and sources."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import WIKIDATA
from ..functions import text as X
from ..operators import classes, graph, nested
from ..plans import bgp
from ..sources import badrows, csvtext, html, rdfxml
from ..sources.tables import table
from .problems import NESTED, SPLIT
from .sqltext import TRIPLES

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


# Classes: customers have their market segment as type, parts their type and brand ------------------------------------

ONTOLOGY = [("Thing", 0), ("Agent", 1), ("Customer", 2), ("MACHINERY", 3), ("BUILDING", 3), ("AUTOMOBILE", 4), ("Object", 1), ("Part", 2), ("STANDARD", 3), ("ECONOMY", 4), ("PROMO", 3)]
SYNONYMS = [(c, c) for c, n in ONTOLOGY if n > 2] + [("HOUSEHOLD", "Customer"), ("SMALL", "Part"), ("LARGE", "Part"), ("MEDIUM", "Object")]
EQUIVALENTS = [("AUTOMOBILE", "MACHINERY"), ("PROMO", "Object")]
KEYWORDS = ("machine", "auto", "promo")
CLASS_URL = "http://kb.example/class/"


def _values(rows: list[tuple], names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) AS v({names}))"


TYPES = f"""types AS (SELECT 'c' || c_custkey AS entity, c_mktsegment AS name, '{CLASS_URL}' || c_mktsegment AS url FROM customer
  UNION ALL SELECT 'p' || p_partkey, p_type, '{CLASS_URL}' || p_type FROM part UNION ALL SELECT 'p' || p_partkey, p_brand, '{CLASS_URL}' || p_brand FROM part),
depths AS {_values(ONTOLOGY, 'class, depth')}, syn AS {_values(SYNONYMS, 'name, class')}, equiv AS {_values(EQUIVALENTS, 'class, eq')},
direct AS (SELECT DISTINCT entity, class FROM types JOIN syn USING (name)),
cand AS (SELECT DISTINCT entity, class, greatest(depth, 1) AS depth FROM (SELECT * FROM direct UNION SELECT entity, eq FROM direct JOIN equiv USING (class)) JOIN depths USING (class)),
tt AS (SELECT entity, string_agg(DISTINCT name, ' ' ORDER BY name) AS type_text, count(DISTINCT name) AS n_types FROM types GROUP BY 1)"""
_DESC = """, facts AS (SELECT tt.*, coalesce('a ' || lower(c_mktsegment) || ' buyer of ' || lower(c_mktsegment), p_name || ' ' || p_type) AS description FROM tt
  LEFT JOIN customer ON entity = 'c' || c_custkey LEFT JOIN part ON entity = 'p' || p_partkey),
sc AS (SELECT entity, coalesce(class, 'Thing') AS class, depth, CASE WHEN class IS NULL THEN 0.0 ELSE (depth + CASE WHEN contains(type_text, class) THEN 10 ELSE 0 END)
  * CASE WHEN depth > 2 THEN greatest(1, (length(description) - length(replace(lower(description), lower(class), ''))) // length(class)) ELSE 1 END / n_types::double END AS score FROM facts LEFT JOIN cand USING (entity)),
ranked AS (SELECT entity, class, round(score, 6)::double AS score, row_number() OVER (PARTITION BY entity ORDER BY score DESC, depth NULLS LAST, class) AS rank FROM sc)"""


def _types(s, d) -> DataFrame:
    c = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), F.col("c_mktsegment").alias("name"))
    p = table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity"), F.explode(F.array("p_type", "p_brand")).alias("name"))
    return c.unionByName(p).withColumn("url", F.concat(F.lit(CLASS_URL), "name"))


def _candidates(s, d) -> DataFrame:
    return classes.candidates(_types(s, d), s.createDataFrame(SYNONYMS, "name string, class string"), s.createDataFrame(EQUIVALENTS, "class string, eq string"), s.createDataFrame(ONTOLOGY, "class string, depth int"))


def _ranked(s, d) -> DataFrame:
    seg = F.lower("c_mktsegment")
    c = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), F.concat(F.lit("a "), seg, F.lit(" buyer of "), seg).alias("description"))
    p = table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity"), F.concat_ws(" ", "p_name", "p_type").alias("description"))
    facts = classes.type_text(_types(s, d)).join(c.unionByName(p), "entity", "left")
    return classes.rank_classes(_candidates(s, d), facts)


@query("SELECT DISTINCT url, regexp_extract(regexp_extract(url, '([^/#]+)$', 1), '([^0-9]+)', 1) AS name FROM client6380 WHERE url IS NOT NULL")
def local_name(s, d):
    return table(s, d, "client6380").where("url is not null").select("url", X.local_name(F.col("url")).alias("name")).distinct()


@query(f"WITH {TYPES} SELECT entity, class, depth FROM cand")
def class_candidates(s, d):
    return _candidates(s, d)


@query(f"WITH {TYPES} SELECT name, url, count(*) AS n FROM types GROUP BY 1, 2")
def class_mapping(s, d):
    return classes.class_mapping(_types(s, d))


@query(f"WITH {TYPES}{_DESC} SELECT entity, class, score, rank FROM ranked")
def class_ranking(s, d):
    return _ranked(s, d)


@query(f"WITH {TYPES}{_DESC} SELECT entity, class, score FROM ranked WHERE rank = 1")
def immediate_class(s, d):
    return classes.immediate(_ranked(s, d))


@query(f"WITH {TYPES} SELECT entity FROM tt WHERE contains(lower(type_text), 'machine') OR contains(lower(type_text), 'auto') OR contains(lower(type_text), 'promo')")
def domain_filter(s, d):
    return classes.type_text(_types(s, d)).where(classes.in_domain(F.col("type_text"), KEYWORDS)).select("entity")


@query(f"WITH {TYPES} SELECT entity, type_text, n_types FROM tt")
def type_entity(s, d):
    return classes.type_text(_types(s, d))


@query("SELECT code, list_extract(string_split(immediate_class, ','), 1) AS head FROM client6380 WHERE immediate_class IS NOT NULL AND immediate_class <> 'Thing,0' GROUP BY ALL")
def class_head(s, d):
    """Head of the stored ranking of the cache; the sentinel of entities without a class is left out."""
    return table(s, d, "client6380").where("immediate_class is not null and immediate_class <> 'Thing,0'").select("code", F.split_part("immediate_class", F.lit(","), F.lit(1)).alias("head")).distinct()


# Basic graph patterns -----------------------------------------------------------------------------------------------


def _sql_steps(patterns: list[tuple[str, str, str]], tag: str = "j") -> tuple[str, str]:
    """Common table expressions that match the patterns one by one, each joined to the matches so far by what it shares
    with them, from a constant outward; the name of the last one has a column per variable."""
    todo, known, steps = list(patterns), [], []
    while todo:
        best = max(todo, key=lambda p: (sum(t in known for t in p), sum(not t.startswith("?") for t in (p[0], p[2]))))
        todo.remove(best)
        conds, new = [], []
        for c, t in zip("spo", best):
            if not t.startswith("?"):
                conds.append(f"t.{c} = '{t}'")
            elif t in known:
                conds.append(f"t.{c} = b.{t[1:]}")
            elif t in [x for x, _ in new]:
                conds.append(f"t.{c} = t.{dict(new)[t]}")
            else:
                new.append((t, c))
        cols = [f"b.{t[1:]}" for t in known] + [f"t.{c} AS {t[1:]}" for t, c in new]
        k = len(steps)
        source = f"{tag}{k - 1} b JOIN triples t ON {' AND '.join(conds)}" if k else f"triples t WHERE {' AND '.join(conds) or 'true'}"
        steps.append(f"{tag}{k} AS MATERIALIZED (SELECT {', '.join(cols) or '1 AS one'} FROM {source})")
        known += [t for t, _ in new]
    return ", ".join(steps), f"{tag}{len(steps) - 1}"


def _sql_differ(b: bgp.Bgp) -> str:
    word = lambda t: t[1:] if t.startswith("?") else f"'{t}'"
    return " AND ".join(f"{word(x)} <> {word(y)}" for x, y in b.differ) or "true"


def _sql_bgp(b: bgp.Bgp) -> str:
    steps, last = _sql_steps(list(b.patterns))
    return f"WITH {TRIPLES}, {steps} SELECT {', '.join(v[1:] for v in b.variables)} FROM {last} WHERE {_sql_differ(b)}"


#: Endpoints of each template, chosen so that there are matches at the smaller scales.
DIRECT = {1: ("n0", "r0"), 2: ("o1", "s1"), 3: ("o1", "n0"), 4: ("o1", "r0")}
MIDDLE = {(1, 1, "in"): ("p0", "p1"), (1, 1, "out"): ("s0", "s1"), (1, 2, "in"): ("c0", "p0"), (1, 2, "out"): ("c0", "s1"), (2, 1, "in"): ("o1", "p0"), (2, 1, "out"): ("n0", "p1"), (1, 3, "in"): ("n0", "p1"), (1, 3, "out"): ("s1", "r0"), (3, 1, "in"): ("o1", "s1"), (3, 1, "out"): ("r0", "s1"), (2, 2, "in"): ("o1", "o2"), (2, 2, "out"): ("n0", "n1")}


def _template(name: str, b: bgp.Bgp) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return bgp.evaluate(b, graph.stored(s, d))

    run.__name__ = name
    query(_sql_bgp(b))(run)


for _d, (_a, _b) in DIRECT.items():
    _template(f"relfinder_direct_d{_d}", bgp.Bgp.direct(_a, _b, _d))
for (_m, _n, _way), (_a, _b) in MIDDLE.items():
    _template(f"relfinder_mid_{_m}_{_n}_{_way}", bgp.Bgp.via_middle(_a, _b, _m, _n, _way == "in"))
_template("relfinder_filter_cycles_1", bgp.Bgp.via_middle("o1", "o2", 2, 2, True).filtered(cycles=1, ends=("o1", "o2")))
_template("relfinder_filter_cycles_2", bgp.Bgp.via_middle("n0", "n1", 2, 2, False).filtered(cycles=2, ends=("n0", "n1")))
_template("relfinder_filter_ignored", bgp.Bgp.direct("o1", "r0", 4).filtered(ignored_objects=("c0", "p0"), ignored_properties=("P3",), ends=("o1", "r0")))


@query(_sql_bgp(bgp.Bgp.direct("o1", "r0", 4)) + " ORDER BY ALL LIMIT 3")
def relfinder_limit(s, d):
    """A template with LIMIT, in the order of its columns."""
    b = bgp.Bgp.direct("o1", "r0", 4)
    return bgp.evaluate(bgp.Bgp(b.patterns, limit=3), graph.stored(s, d))


_ALL = bgp.templates("o1", "p0", 4, cycles=1)


def _sql_all() -> str:
    steps, parts = [TRIPLES], []
    for n, b in enumerate(_ALL):
        mine, last = _sql_steps(list(b.patterns), f"j{n}_")
        steps.append(mine)
        word = lambda t: t[1:] if t.startswith("?") else f"'{t}'"
        match = " || ' . ' || ".join(" || ' ' || ".join(map(word, p)) for p in b.patterns)
        parts.append(f"SELECT {b.distance} AS distance, '{b.name}' AS template, {match} AS match FROM {last} WHERE {_sql_differ(b)}")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(parts)


@query(_sql_all())
def relfinder_all(s, d):
    """All templates between o1 and p0 in up to four edges."""
    return bgp.relate(_ALL, graph.stored(s, d))


LOCATED = bgp.Bgp((("?n", "P2", "?e2"), ("?e1", "P1", "?n"), ("?o", "P3", "?e1")))
SUPPLIED = bgp.Bgp((("?n", "P2", "?e2"), ("?s", "P1", "?n"), ("?p", "P5", "?s"), ("?o", "P4", "?p"), ("?o", "P3", "?e1")))


@query(f"""WITH {TRIPLES}, loc AS MATERIALIZED (SELECT b.s AS x, a.o AS r FROM triples a JOIN triples b ON b.o = a.s AND b.p = 'P1' WHERE a.p = 'P2'),
    made AS MATERIALIZED (SELECT DISTINCT c.s AS part, r FROM triples c JOIN loc ON c.o = loc.x WHERE c.p = 'P5'), sold AS MATERIALIZED (SELECT DISTINCT e.s AS sale, r FROM triples e JOIN made ON e.o = made.part WHERE e.p = 'P4'),
    m AS (SELECT DISTINCT loc.x AS e1, r AS e2, 'located' AS pattern FROM loc JOIN triples c ON c.o = loc.x AND c.p = 'P3' UNION ALL SELECT DISTINCT f.o, r, 'supplied' FROM sold JOIN triples f ON f.s = sold.sale AND f.p = 'P3')
    SELECT e1, e2, count(*) AS n_patterns, string_agg(pattern, '**' ORDER BY pattern) AS patterns FROM m GROUP BY 1, 2""")
def related_pairs(s, d):
    """Customers and regions: where they are, and where the suppliers of what they ordered are."""
    return bgp.related_pairs({"located": LOCATED, "supplied": SUPPLIED}, graph.stored(s, d))


@query(f"WITH {TRIPLES} SELECT count(*) AS n FROM triples a JOIN triples b ON a.p = 'P3' AND b.p = 'P4' AND a.s = b.s")
def bgp_count(s, d):
    return bgp.count(bgp.Bgp(tuple([("?o", "P3", "?c"), ("?o", "P4", "?p")])), graph.stored(s, d))


@query(f"""WITH {TRIPLES}, m AS (SELECT DISTINCT 'Q' || c.s AS e1, 'Q' || a.o AS e2, 'P3/P1' AS pattern FROM triples c JOIN triples a ON a.s = c.o AND a.p = 'P1' WHERE c.p = 'P3'
    UNION ALL SELECT * FROM (SELECT DISTINCT 'Q' || c.s AS e1, 'Q' || b.o AS e2, 'P3/P1/P2' AS pattern FROM triples c JOIN triples a ON a.s = c.o AND a.p = 'P1' JOIN triples b ON b.s = a.o AND b.p = 'P2' WHERE c.p = 'P3' ORDER BY 1, 2 LIMIT 500))
    SELECT e1, e2, count(*) AS n_patterns, string_agg(pattern, '**' ORDER BY pattern) AS patterns FROM m GROUP BY 1, 2""")
def related_pairs_items(s, d):
    """Pairs of items (Q codes), from queries given as text; one of them with a LIMIT."""
    e = graph.stored(s, d).by_subject
    items = graph.keep_items(e.select("s", "p", F.concat(F.lit("Q"), "o").alias("value")), WIKIDATA).select(F.concat(F.lit("Q"), "s").alias("s"), "p", F.col("value").alias("o"))
    near = bgp.Bgp.parse("SELECT ?e1 ?e2 WHERE { ?e1 <P3> ?c . ?c <P1> ?e2 }")
    far = bgp.Bgp.parse("SELECT ?e1 ?e2 WHERE { ?e1 <P3> ?c . ?c <P1> ?n . ?n <P2> ?e2 } LIMIT 500")
    return bgp.related_pairs({"P3/P1": near, "P3/P1/P2": far}, items)


@query(_sql_bgp(bgp.Bgp((("?o", "P3", "?c"), ("?c", "P1", "n1")))))
def bgp_text_query(s, d):
    """A query given as text, parsed and evaluated."""
    return bgp.evaluate(bgp.Bgp.parse("SELECT * WHERE { ?o <P3> ?c . ?c <P1> <n1> }"), graph.stored(s, d))


@query("SELECT DISTINCT url, CASE WHEN regexp_matches(url, '^(rdf|skos):') THEN url WHEN starts_with(url, 'http://www.w3.org/2004/02/skos/core#') THEN 'skos:' || substr(url, 37) ELSE '<' || url || '>' END AS short FROM (SELECT url FROM client6380 UNION ALL SELECT 'http://www.w3.org/2004/02/skos/core#' || code FROM client6380) WHERE url IS NOT NULL")
def uri_compact(s, d):
    c = table(s, d, "client6380")
    u = c.select("url").unionByName(c.select(F.concat(F.lit(X.NAMESPACES["skos"]), "code").alias("url"))).where("url is not null").distinct()
    return u.select("url", X.compact_uri(F.col("url")).alias("short"))


@query("SELECT code, '?s ' || code || ' ?o . ?o p ?x' AS body FROM (SELECT DISTINCT code FROM client6380 WHERE code IS NOT NULL)")
def bgp_extract(s, d):
    q = F.concat(F.lit("SELECT * WHERE { ?s <"), "code", F.lit("> ?o . ?o <p> ?x FILTER ((?o != <"), "code", F.lit(">)) } LIMIT 10"))
    return table(s, d, "client6380").where("code is not null").select("code").distinct().select("code", X.bgp_text(q).alias("body"))


# Texts and sources --------------------------------------------------------------------------------------------------


def _pages(s, d) -> DataFrame:
    """A page per customer with a link to its nation, a list and its name; HTML that is not well formed."""
    n = table(s, d, "customer")
    body = F.concat(F.lit('<html><body><p><ul><li><a href="/region/'), F.col("c_nationkey").cast("string"), F.lit('">region</a><li><a href="/suppliers/'), F.col("c_custkey").cast("string"), F.lit('">s</a></ul><b>'), "c_name", F.lit("</body></html>"))
    return n.select(F.concat(F.lit("http://kb.example/page/n"), F.col("c_custkey").cast("string")).alias("page"), body.alias("html"))


@query(r"""SELECT doc_id, regexp_extract(speaker, '([A-Za-z]+)', 1) AS word, trim(regexp_replace(speaker, '\s+', ' ', 'g')) AS tidy, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(agenda_item, '\s+'), lambda w: w <> ''))), '|') AS words,
    len(list_filter(regexp_split_to_array(agenda_item, '\s+'), lambda w: w <> ''))::int AS n_words FROM documents""")
def words_of_documents(s, d):
    """First word of the speaker, the speaker with single blanks, the distinct words of the agenda item."""
    t = table(s, d, "documents")
    return t.select("doc_id", X.first_word(F.col("speaker")).alias("word"), X.one_space(F.col("speaker")).alias("tidy"), F.array_join(F.array_sort(X.distinct_words(F.col("agenda_item"))), "|").alias("words"), F.when(F.col("agenda_item").isNotNull(), F.size(X.words(F.col("agenda_item")))).alias("n_words"))


@query("SELECT DISTINCT code, url, CASE WHEN starts_with(url, 'http://kb.example/resource/') THEN substr(url, 28) ELSE url END AS rest, array_to_string(list_filter(string_split(immediate_class, ','), lambda w: w <> ''), ';') AS items FROM client6380 WHERE code IS NOT NULL")
def parts_of_entries(s, d):
    """Addresses without their prefix, and the items of the stored ranking."""
    c = table(s, d, "client6380").where("code is not null")
    return c.select("code", "url", X.strip_prefix(F.col("url"), "http://kb.example/resource/").alias("rest"), F.array_join(X.comma_items(F.col("immediate_class")), ";").alias("items")).distinct()


@query("SELECT DISTINCT node, regexp_extract(concat_ws('@', node, upper(trim(side))), '@([A-Z0-9_])$', 1) AS side, least(node, 'n0') || ',' || greatest(node, 'n0') AS key FROM l_wobject_extend WHERE node IS NOT NULL")
def sides_and_keys(s, d):
    """The side read back from ``node@side``; the key of two nodes that is the same in either order."""
    f = table(s, d, "l_wobject_extend").where("node is not null")
    at = F.concat_ws("@", "node", F.upper(F.trim("side")))
    return f.select("node", X.side_suffix(at).alias("side"), X.unordered_key(F.col("node"), F.lit("n0")).alias("key")).distinct()


@query("SELECT pattern_id, '{' || freq_pattern || '}' AS head FROM pattern_tool WHERE freq_pattern IS NOT NULL GROUP BY 1, 2")
def key_heads(s, d):
    """The part of a pattern's key before its size."""
    t = table(s, d, "pattern_tool").where("freq_pattern is not null").select("pattern_id", F.concat(F.lit("{"), "freq_pattern", F.lit("}:"), F.coalesce(F.col("size").cast("string"), F.lit("{}:")))).distinct()
    return t.select("pattern_id", X.key_head(F.col(t.columns[1])).alias("head")).distinct()


@query("SELECT DISTINCT entity_name, entity_name AS title FROM client6380 WHERE entity_name IS NOT NULL")
def article_titles(s, d):
    """Titles read from the language links of pages made from the names of all entries."""
    c = table(s, d, "client6380").where("entity_name is not null").select("entity_name").distinct()
    page = F.concat(F.lit('<a class="x" href="https://en.example.org/wiki/'), F.replace(F.url_encode("entity_name"), F.lit("+"), F.lit("_")), F.lit('" hreflang="en">'))
    return c.select("entity_name", X.wiki_title(page).alias("title"))


@query("SELECT 'http://kb.example/page/n' || c_custkey AS page, unnest(['/region/' || c_nationkey, '/suppliers/' || c_custkey]) AS href FROM customer")
def page_links(s, d):
    return html.links(_pages(s, d), "page", "html")


@query("SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: x <> '')) AS line FROM documents")
def split_lines(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(X.lines(F.col("text"))).alias("line"))


@query("SELECT 'http://kb.example/page/n' || c_custkey AS page, 'http://kb.example/data/n' || c_custkey || '.rdf' AS data_url, 'http://kb.example/resource/n' || c_custkey AS resource_url FROM customer")
def url_rewrite(s, d):
    return _pages(s, d).select("page", X.data_url(F.col("page")).alias("data_url"), X.resource_url(F.col("page")).alias("resource_url"))


@query("SELECT c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN 'http://xmlns.com/foaf/0.1/' WHEN c_custkey % 3 = 1 THEN 'http://purl.org/dc/terms/' END) || c_name AS uri FROM customer")
def ns_expand(s, d):
    ns = s.createDataFrame([("foaf", "http://xmlns.com/foaf/0.1/"), ("dcterms", "http://purl.org/dc/terms/")], "prefix string, uri string")
    k = F.col("c_custkey") % 3
    named = table(s, d, "customer").select("c_custkey", F.concat(F.when(k == 0, "foaf").when(k == 1, "dcterms").otherwise("none"), F.lit(":"), "c_name").alias("name"))
    return rdfxml.expand_names(named, "name", ns).select("c_custkey", "uri")


@query(f"""WITH {NESTED} SELECT DISTINCT record_id, 'p:' || p || '/ps:' || p AS flat_prop, stmt_no, 0 AS qual_no, st ->> 'url' AS url, st ->> 'value' AS value FROM st WHERE p <> '' AND (coalesce(st ->> 'url', '') <> '' OR coalesce(st ->> 'value', '') <> '')
    UNION ALL SELECT DISTINCT record_id, 'p:' || p || '/pq:' || upper(trim(code)), stmt_no, qual_no, url, value FROM q3 WHERE p <> '' AND coalesce(trim(code), '') <> '' AND (coalesce(url, '') <> '' OR coalesce(value, '') <> '')""")
def wikidata_flatten(s, d):
    """Statements and qualifiers of all documents with their values."""
    return nested.flat_statements(nested.dewey_nodes(table(s, d, "xmlparser"), "record_id", "property"), "record_id").distinct()


@query("SELECT DISTINCT description, replace(replace(description || '\\\"', '\\', '\\\\'), '\"', '\\\"') AS escaped FROM client6380 WHERE description IS NOT NULL")
def escape_quotes(s, d):
    return table(s, d, "client6380").where("description is not null").select("description").distinct().select("description", X.escape_quotes(F.concat("description", F.lit('\\"'))).alias("escaped"))


@query("SELECT inter_id, start_node AS a, end_node AS b FROM (SELECT DISTINCT inter_id, start_node, end_node FROM intersection_paths WHERE start_node IS NOT NULL AND end_node IS NOT NULL)")
def split_pair(s, d):
    p = table(s, d, "intersection_paths").where("start_node is not null and end_node is not null").select("inter_id", "start_node", "end_node").distinct()
    a, b = X.split_pair(F.concat_ws("@", "start_node", "end_node"))
    return p.select("inter_id", a.alias("a"), b.alias("b"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def substr_count(s, d):
    return table(s, d, "documents").select("doc_id", X.count_literal(F.col("text"), F.lit("the")).alias("n"))


@query("SELECT entity, value FROM (SELECT 'c' || c_custkey AS entity, 'http://html/' || c_name AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'c' || c_custkey, 'http://rdf/' || c_name FROM customer WHERE c_custkey % 2 = 1)")
def source_fallback(s, d):
    """Documents from pages; from RDF where the page has no link."""
    c = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), "c_name", (F.col("c_custkey") % 2).alias("k"))
    pages = c.select("entity", F.when(F.col("k") == 0, F.concat(F.lit("http://html/"), "c_name")).otherwise("no link").alias("value"))
    return html.with_fallback(pages, c.select("entity", F.concat(F.lit("http://rdf/"), "c_name").alias("value")))


@query("SELECT code, coalesce(min(description), 'No label defined') AS description FROM client6380 WHERE code IS NOT NULL GROUP BY 1")
def cached_description(s, d):
    """Left join with the cache; the sentinel where it knows nothing."""
    c = table(s, d, "client6380").where("code is not null")
    known = c.where("description is not null").groupBy("code").agg(F.min("description").alias("description"))
    return c.select("code").distinct().join(known, "code", "left").select("code", F.coalesce("description", F.lit("No label defined")).alias("description"))


@query("SELECT DISTINCT url, array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9]') THEN c WHEN c = ' ' THEN '+' ELSE regexp_replace(hex(c), '(..)', '%\\1', 'g') END), '') AS encoded, url AS decoded FROM client6380 WHERE url IS NOT NULL")
def url_coding(s, d):
    """Every URL in form encoding, where ``+`` stands for a blank only, and decoded again."""
    u = table(s, d, "client6380").select("url").where("url is not null").distinct().withColumn("encoded", X.url_encode(F.col("url")))
    return u.withColumn("decoded", X.url_decode(F.replace("encoded", F.lit("+"), F.lit("%20"))))


@query(f"""WITH {SPLIT}, q AS (SELECT DISTINCT query_id, line_id FROM sparql)
    SELECT DISTINCT query_id, line_id, NULL::varchar AS reason, variable, value FROM e JOIN q USING (line_id)
    UNION ALL SELECT query_id, line_id, CASE WHEN texto IS NULL OR header IS NULL OR splits THEN 'column_count' ELSE 'quoting' END, NULL, NULL FROM u JOIN q USING (line_id) WHERE blank OR NOT splits OR len(names) <> len(vals)""")
def csv_rows(s, d):
    """Every record read by its own header: a row per variable; a record that cannot be read keeps a row with the reason."""
    r = table(s, d, "sparql").select("query_id", "line_id", "header", "texto")
    return badrows.load_records(r, domains={}).select("query_id", "line_id", "reason", F.explode_outer("fields").alias("variable", "value")).distinct()


@query("SELECT query_id, count(*) AS n FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(texto, '[\\r\\n]+'), lambda x: x <> '')) AS l FROM (SELECT DISTINCT line_id, query_id, texto FROM sparql) WHERE texto IS NOT NULL) GROUP BY 1")
def csv_chunks(s, d):
    """Results that come in chunks cut in the middle of records: records per query after the header."""
    one = table(s, d, "sparql").where("texto is not null").select("line_id", "query_id", F.concat("texto", F.lit("\n")).alias("t")).distinct()
    half = F.floor(F.length("t") / 2).cast("int")
    at = lambda k, x: F.struct((2 * F.col("line_id") + k).alias("k"), x.alias("c"))
    parts = one.select("query_id", F.explode(F.array(at(1, F.substring("t", F.lit(1), half)), at(2, F.substring("t", half + 1, F.length("t"))))).alias("e")).select("query_id", "e.k", "e.c")
    heads = one.select("query_id").distinct().select("query_id", F.lit(-1).cast("long").alias("k"), F.lit("head\n").alias("c"))
    recs = csvtext.records(parts.unionByName(heads), "query_id", "k", "c")
    return recs.groupBy("query_id").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")


@query("SELECT 'q' || c_nationkey AS query, c_custkey AS k, 'http://kb.example/n' || c_custkey AS s, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer")
def sparql_xml_rows(s, d):
    """XML results bound by variable name; unbound variables are null."""
    n = table(s, d, "customer")
    k = F.col("c_custkey").cast("string")
    xml = F.concat(F.lit('<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head><variable name="s"/><variable name="name"/></head><results><result><binding name="s"><uri>http://kb.example/n'), k, F.lit("</uri></binding>"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('<binding name="name"><literal>'), "c_name", F.lit("</literal></binding>"))).otherwise(""), F.lit("</result></results></sparql>"))
    docs = n.select(F.concat(F.lit("q"), F.col("c_nationkey").cast("string"), F.lit(" "), k).alias("id"), xml.alias("x"))
    rows = rdfxml.sparql_results(docs, "id", "x", ["s", "name"])
    return rows.select(F.split_part("id", F.lit(" "), F.lit(1)).alias("query"), F.split_part("id", F.lit(" "), F.lit(2)).cast("long").alias("k"), "s", "name")


@query("SELECT 'n' || c_custkey AS entity, 'http://kb.example/P2' AS p, 1 AS ntype, unnest(['http://dbpedia.org/resource/r' || c_nationkey, c_name]) AS value FROM customer")
def html_table_extract(s, d):
    n = table(s, d, "customer")
    page = F.concat(F.lit('<table><tr><td><a class="uri" href="http://kb.example/P2">region</a></td><td><ul><li><a class="uri" href="http://dbpedia.org/resource/r'), F.col("c_nationkey").cast("string"), F.lit('">r</a><li><span property="name" xml:lang="en">'), "c_name", F.lit("</span></ul></td></tr></table>"))
    return html.parse_pages(n.select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("e"), page.alias("h")), "e", "h")


@query("SELECT 'http://kb.example/n' || c_custkey AS entity, unnest(['http://kb.example/region', 'http://kb.example/name', 'http://kb.example/inNation']) AS p, unnest([1, 1, 4]) AS ntype, unnest(['http://kb.example/r' || c_nationkey, c_name, 'http://kb.example/c' || c_custkey]) AS value FROM customer")
def rdfxml_triples(s, d):
    n = table(s, d, "customer")
    k = F.col("c_custkey").cast("string")
    xml = F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:k="http://kb.example/"><rdf:Description rdf:about="http://kb.example/n'), k, F.lit('"><k:region rdf:resource="http://kb.example/r'), F.col("c_nationkey").cast("string"), F.lit('"/><k:name>'), "c_name", F.lit('</k:name></rdf:Description><rdf:Description rdf:about="http://kb.example/c'), k, F.lit('"><k:inNation rdf:resource="http://kb.example/n'), k, F.lit('"/></rdf:Description></rdf:RDF>'))
    return rdfxml.parse_rdfxml(n.select(F.concat(F.lit("http://kb.example/n"), k).alias("entity"), xml.alias("x")), "entity", "x")


@query("SELECT 'Q' || c_custkey AS entity, unnest(['p:P361/ps:P361', 'p:P361/pq:P580']) AS flat_prop, unnest(['Q9' || c_nationkey, NULL]) AS url, unnest(['region', '2001']) AS value FROM customer")
def wikidata_page(s, d):
    n = table(s, d, "customer").select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("e"), F.format_string(STATEMENT_PAGE, "c_name", F.col("c_nationkey").cast("string")).alias("h"))
    docs = html.parse_statement_pages(n, "e", "h")
    return nested.flat_statements(nested.dewey_nodes(docs, "entity", "document"), "entity").select("entity", "flat_prop", "url", "value")


STATEMENT_PAGE = '<span class="wikibase-title-label">%s</span><div class="wikibase-statementgroupview" id="P361"><div class="wikibase-statementgroupview-property"><a href="/wiki/Property:P361">part of</a></div><div class="wikibase-statementview"><div class="wikibase-statementview-mainsnak"><div class="wikibase-snakview-value"><a href="/wiki/Q9%s">region</a></div></div><div class="wikibase-statementview-qualifiers"><div class="wikibase-snakview-property"><a href="/wiki/Property:P580">start</a></div><div class="wikibase-snakview-value">2001</div></div></div></div>'

QUERIES, SQL = Q, S
