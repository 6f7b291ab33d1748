import json

from pathweave.operators import nested as n

PLAIN = {"P1": {"name": "a", "list_statement": [{"url": "Q1", "value": "v", "list": [["P2", "b", "x"], ["P3", "c", "Q2", "label"]]}, {"value": "w"}]}}
AS_LIST = [{"property": "P1", "name": "a", "list_statement": PLAIN["P1"]["list_statement"]}]
OBJECTS = {"P1": {"name": "a", "list_statement": [{"url": "Q1", "value": "v", "list": [{"property": "P2", "name": "b", "value": "x"}, {"property": "P3", "name": "c", "url": "Q2", "value": "label"}]}, {"value": "w"}]}}
TEXT = {"P1": {"name": "a", "list_statement": json.dumps(PLAIN["P1"]["list_statement"])}}


def flat(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "record_id long, property string")
    rows = n.flat_statements(n.dewey_nodes(df, "record_id", "property"), "record_id").collect()
    return [sorted(tuple(r)[1:] for r in rows if r.record_id == k) for k in range(len(docs))]


def test_shapes_give_the_same_tables(spark):
    a, b, c, d = flat(spark, [json.dumps(x) for x in (PLAIN, AS_LIST, OBJECTS, TEXT)])
    assert a == b == c == d == sorted([("p:P1/ps:P1", 1, 0, "Q1", "v"), ("p:P1/ps:P1", 2, 0, None, "w"), ("p:P1/pq:P2", 1, 1, None, "x"), ("p:P1/pq:P3", 1, 2, "Q2", "label")])


def test_ordinals_count_what_is_no_case(spark):
    doc = {"P1": {"list_statement": [None, {"url": ""}, {"value": 0, "list": [[], None, ["P2", "b"], [None, "c", "x"], ["P3", "d", None], ["P4", "e", 5]]}]}, "P2": None, "P3": {"list_statement": {"value": "one", "list": ["P5", "f", "y"]}}}
    assert flat(spark, [json.dumps(doc)])[0] == sorted([("p:P1/ps:P1", 3, 0, None, "0"), ("p:P1/pq:P4", 3, 6, None, "5"), ("p:P3/ps:P3", 1, 0, None, "one"), ("p:P3/pq:P5", 1, 1, None, "y")])


def test_nulls_and_malformed(spark):
    assert flat(spark, [None, "", "{", "3", "[]", "{}", '{"P1": 4}']) == [[]] * 7
    df = spark.createDataFrame([(1, None), (2, "{"), (3, "{}")], "i long, j string")
    assert [r.i for r in n.malformed(df, "i", "j").collect()] == [2]
    assert n.dewey_nodes(df.where("false"), "i", "j").count() == 0


def test_parents_by_truncation(spark):
    df = spark.createDataFrame([(7, json.dumps(PLAIN), "x")], "record_id long, property string, fields string")
    nodes = n.dewey_nodes(df, "record_id", "property").collect()
    labels = {r.dewey for r in nodes}
    for r in nodes:
        assert r.parent == (r.dewey.rpartition(".")[0] or None) and (r.parent is None or r.parent in labels)
    t = n.node_table(n.dewey_nodes(df, "record_id", "property"), n.QUALIFIERS.path, {"code": "property"}).orderBy("dewey").collect()
    assert [(r.record_id, r.dewey, r.parent_dewey, r.code) for r in t] == [(7, "1.1.1", "1.1", "P2"), (7, "1.1.2", "1.1", "P3")]


def test_very_long_and_deep(spark):
    many = {f"P{i}": {"list_statement": [{"value": "x" * 1000}]} for i in range(2000)}
    deep = "[" * 100_000
    out = flat(spark, [json.dumps(many), deep])
    assert len(out[0]) == 2000 and out[1] == []


def test_statements_written_as_arrays(spark):
    doc = {"P31": {"list_statement": [["Q5", "human"], ["Q6"], ["Q7", "x", [["P1", "n", "v"]]], {"url": "Q8"}]}}
    got = flat(spark, [json.dumps(doc)])[0]
    assert set(got) == {("p:P31/ps:P31", 1, 0, "Q5", "human"), ("p:P31/ps:P31", 2, 0, "Q6", None), ("p:P31/ps:P31", 3, 0, "Q7", "x"), ("p:P31/pq:P1", 3, 1, None, "v"), ("p:P31/ps:P31", 4, 0, "Q8", None)}


def test_nothing_is_dropped():
    nodes = n.label('{"P1": {"list_statement": [{"value": "a", "value": "b", "list": [["P2", "n", "u", "l", "fifth", 6]], "list": [["P3", "n", "x"]]}, ["Q1", "v", [], "more"]]}, "P1": {"name": "again", "list_statement": [{"value": "c"}]}}', n.STATEMENT_DOCUMENT)
    by = {x[0]: x for x in nodes}
    assert [by[k][5]["property"] for k in ("1", "2")] == ["P1", "P1"] and by["2"][5]["name"] == "again"
    assert by["1.1"][5] == {"value": "b", "extra": '["a"]'} and by["2.1"][5] == {"value": "c"}
    assert by["1.1.1"][5] == {"property": "P2", "name": "n", "url": "u", "value": "l", "extra": '["fifth", 6]'} and by["1.1.2"][5] == {"property": "P3", "name": "n", "value": "x"}
    assert by["1.2"][5] == {"url": "Q1", "value": "v", "extra": '["more"]'}


def test_tables_from_one_parse(spark):
    df = spark.createDataFrame([(7, json.dumps(PLAIN), "x")], "record_id long, property string, path string")
    t = n.flat_tables(df, "record_id", "property", {n.STATEMENTS.path: {"url": "url", "value": "value"}, n.QUALIFIERS.path: {"code": "property"}})
    assert [(r.dewey, r.parent_dewey, r.url, r.value) for r in t[n.STATEMENTS.path].orderBy("dewey").collect()] == [("1.1", "1", "Q1", "v"), ("1.2", "1", None, "w")]
    assert [r.code for r in t[n.QUALIFIERS.path].orderBy("dewey").collect()] == ["P2", "P3"]
