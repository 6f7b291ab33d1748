import pytest

from pathweave.plans.bgp import Bgp, answer, conjunction, evaluate, templates

T = [("a", "p", "b"), ("b", "q", "c"), ("c", "p", "a"), ("a", "p", "c"), ("b", "p", "b")]


def test_counts_of_templates():
    all_ = templates("o1", "o2", 4)
    assert [sum(b.distance == d for b in all_) for d in (1, 2, 3, 4)] == [2, 4, 6, 8]


def test_shapes():
    assert Bgp.direct("o1", "o2", 2).patterns == (("o1", "?pf1", "?of1"), ("?of1", "?pf2", "o2"))
    assert Bgp.via_middle("o1", "o2", 2, 1, True).patterns == (("o1", "?pf1", "?of1"), ("?of1", "?pf2", "?middle"), ("o2", "?ps1", "?middle"))
    f = Bgp.via_middle("o1", "o2", 2, 1, True).filtered(cycles=2, ends=("o1", "o2"))
    assert ("?middle", "?of1") in f.differ and ("?of1", "?middle") in f.differ and ("?of1", "o1") in f.differ
    assert conjunction(["a", "b"]) == "((a) && (b))"


def test_text_round_trip():
    for b in templates("o1", "o2", 3, limit=5, cycles=2, ignored_properties=("p9",)):
        back = Bgp.parse(b.text())
        assert (back.patterns, set(back.differ), back.limit) == (b.patterns, set(b.differ), 5)
    with pytest.raises(ValueError):
        Bgp.parse("SELECT")


def test_evaluate(spark):
    t = spark.createDataFrame(T, "s string, p string, o string")
    rows = {tuple(r) for r in evaluate(Bgp((("?x", "p", "?y"), ("?y", "q", "?z"))), t).collect()}
    assert rows == {("a", "b", "c"), ("b", "b", "c")}
    assert {tuple(r) for r in evaluate(Bgp((("?x", "?r", "?x"),)), t).collect()} == {("b", "p")}
    assert evaluate(Bgp((("a", "p", "?y"),), differ=(("?y", "b"),)), t).collect()[0].y == "c"
    lit = spark.createDataFrame([("a", "p", "text")], "s string, p string, o string")
    assert evaluate(Bgp((("a", "p", "?y"),), entities=("?y",)), t, lit).count() == 2
    assert evaluate(Bgp((("a", "p", "?y"),)), t, lit).count() == 3


@pytest.mark.parametrize("text", [
    "SELECT * WHERE { ?a <p> ?b FILTER (?b = <x>) }",
    "SELECT * WHERE { ?a <p> ?b FILTER (?a != <x> || ?b != <y>) }",
    "SELECT * WHERE { ?a <p> ?b . ?b <q> }",
    "SELECT * WHERE { ?a <p> ?b OPTIONAL { ?b <q> ?c } }",
    "SELECT * WHERE { ?a <p> ?b } ORDER BY ?a",
    "SELECT * WHERE { ?a <p> \"x\" }",
    "SELECT * WHERE { ?a n:p ?b }",
    "SELECT ?c WHERE { ?a <p> ?b }",
    "SELECT * WHERE { ?a <p> ?b FILTER (?c != ?a) }",
    "SELECT * WHERE { ?a <p> ?b FILTER (?a != ?b }",
    "SELECT * WHERE { ?a <p>/<q> ?b }",
    "SELECT * WHERE { }",
    "ASK { ?a <p> ?b }",
    "",
])
def test_what_is_not_understood_is_an_error(text):
    with pytest.raises(ValueError):
        Bgp.parse(text)


def test_answers(spark):
    t = spark.createDataFrame(T, "s string, p string, o string")
    assert answer("PREFIX n: <> SELECT count(*) WHERE { ?x n:p ?y }", t).first().n == 4
    assert {r.x for r in answer("select distinct ?x where { ?x <p> ?y . FILTER ((?y != <b>) && (?x != ?y)) }", t).collect()} == {"c", "a"}
    assert [r.x for r in answer("SELECT ?x WHERE { ?x <p> ?y . } LIMIT 2", t).collect()] == ["a", "a"]
    assert Bgp.parse("PREFIX k: <http://k/a.b#> SELECT * { ?x k:p.q ?y . ?y ?r k:z . }").patterns == (("?x", "http://k/a.b#p.q", "?y"), ("?y", "?r", "http://k/a.b#z"))
