from pyspark.sql import functions as F

from pathweave.config import WIKIDATA, SearchConfig
from pathweave.operators import graph, patterns, search

EDGES = [("a", "p", "b"), ("b", "p", "c"), ("a", "q", "d"), ("d", "q", "c"), ("b", "r", "d"), ("c", "p", "e")]


def found(spark, **gates):
    e = spark.createDataFrame(EDGES, "s string, p string, o string")
    return {" ".join(r.path) for r in search.find_paths(search.pairs_of(spark, [("a", "c")]), e, SearchConfig(length=2, max_links=None), **gates).collect()}


def test_gates(spark):
    assert found(spark) == {"a p b p c", "a q d q c"}
    nodes = lambda x: spark.createDataFrame([(n,) for n in x], "node string")
    assert found(spark, domain=nodes("bca")) == {"a p b p c"}
    assert found(spark, classed=nodes("abc")) == {"a p b p c"} and found(spark, classed=nodes("bcd")) == set()
    assert found(spark, classed=nodes("aabbcc")) == {"a p b p c"}


def test_last_round(spark):
    e = spark.createDataFrame(EDGES, "s string, p string, o string")
    got = {(r.node, r.round) for r in search.last_round(search.pairs_of(spark, [("a", "c")]), e, SearchConfig(length=2, max_links=None)).collect()}
    assert got == {("b", 1), ("d", 1), ("a", 2), ("c", 2)}


def test_pages(spark):
    freq = spark.createDataFrame([(f"P{k:02}", 1, k % 4) for k in range(25)], "pattern string, size int, instances int")
    rows = sorted(patterns.pages(freq, 20).collect(), key=lambda r: r["rank"])
    want = sorted(((-(k % 4), f"P{k:02}") for k in range(25)))
    assert [r.pattern for r in rows] == [p for _, p in want] and [r["rank"] for r in rows] == list(range(1, 26))
    assert [r.page for r in rows] == [k // 5 + 1 for k in range(25)]
    assert patterns.pages(freq.where("false")).count() == 0 and {r.page for r in patterns.pages(freq.limit(3)).collect()} == {1, 2, 3}


def test_append_values(spark):
    none = spark.createDataFrame([], "entity string, p string, chunk long, values array<string>")
    new = spark.createDataFrame([("a", "p", f"v{k}", k) for k in range(5, 12)] + [("b", "p", None, 1)], "entity string, p string, value string, seq long")
    one = graph.append_values(none, new, 4)
    assert {(r.entity, r.chunk): r["values"] for r in one.collect()} == {("a", 0): ["v5", "v6", "v7"], ("a", 1): ["v8", "v9", "v10", "v11"], ("b", 0): [None]}
    two = graph.append_values(one, new.where("entity = 'a'").select("entity", "p", "value", (F.col("seq") + 100).alias("seq")), 1000)
    assert {(r.chunk): r["values"] for r in two.where("entity = 'a' and chunk > 1").collect()} == {2: [f"v{k}" for k in range(5, 12)]}


def test_accept(spark):
    terms = spark.createDataFrame([("http://p/1", True, 1), ("http://p/1", True, 3), ("http://p/2", True, 1), ("p", True, 1), ("http://dbpedia.org/resource/X", False, 1), ("http://other/X", False, 1), (None, False, 1)], "url string, is_property boolean, ntype int")
    codes = spark.createDataFrame([("http://p/1", "u1"), ("http://p/2", "u2"), ("p", "u3"), ("http://dbpedia.org/resource/X", "u4"), ("http://other/X", "u5")], "url string, code string")
    out = graph.accept(terms, codes, spark.createDataFrame([("http://p/2",)], "url string"))
    got = {(r.url, r.ntype): (r.ok, r.code) for r in out.collect()}
    assert got == {("http://p/1", 1): (True, "u1"), ("http://p/1", 3): (True, "u1@"), ("http://p/2", 1): (False, None), ("p", 1): (False, None), ("http://dbpedia.org/resource/X", 1): (True, "u4"), ("http://other/X", 1): (False, None), (None, 1): (False, None)}
    doc = spark.createDataFrame([("Q1",), ("x",), (None,)], "value string")
    assert [r.value for r in graph.keep_items(doc, WIKIDATA).collect()] == ["Q1"]


def test_stored_merged_pattern(spark):
    paths = spark.createDataFrame([("x", ["a", "P1", "b", "P2", "c"], 2), ("x", ["a", "P1", "d", "P2", "c"], 2), ("y", ["a", "P3", "b", "P3", "c"], 2)], "pair_id string, path array<string>, len int")
    stored = spark.createDataFrame([("P1 P2", 1, f"s{k}") for k in range(5)], "merged string, pos int, node string")
    assert {(r.pair_id, r.pos, r.n) for r in patterns.complex_bindings(paths, stored).collect()} == {("x", 1, 5), ("y", 1, 1)}
    assert {(r.pair_id, r.pos, r.n) for r in patterns.complex_bindings(paths).collect()} == {("x", 1, 2), ("y", 1, 1)}
