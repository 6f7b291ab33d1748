import pytest
from pyspark.sql import functions as F

from pathweave.config import SearchConfig
from pathweave.operators import paths, patterns, search

EDGES = [("a", "P1", "b"), ("b", "P2", "c"), ("a", "P1", "b"), ("c", "P3", "a"), ("c", "P4", "d"), ("d", "P5", "e"), ("x", "P1", None), ("d", "P5", "d")]


def brute(edges, s, t, longest):
    adj = {}
    for a, p, b in {e for e in edges if None not in e}:
        adj.setdefault(a, set()).add((p, b))
        adj.setdefault(b, set()).add((p + "@", a))
    out, level = set(), [((s,), (s,))]
    for _ in range(longest):
        level = [((*w, p, o), (*n, o)) for w, n in level for p, o in adj.get(n[-1], ()) if o not in n and n[-1] != t]
        out |= {" ".join(w) for w, n in level if n[-1] == t}
    return out


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5])
def test_equals_a_walk_from_one_side(spark, length):
    """Several pairs at once; a pair of equal ends and one with an unknown end have no path."""
    ends = [("a", "d"), ("a", "e"), ("e", "a"), ("a", "a"), ("a", "zz")]
    e = spark.createDataFrame(EDGES, "s string, p string, o string")
    rows = search.find_paths(search.pairs_of(spark, ends), e, SearchConfig(length=length)).select("pair_id", paths.text(F.col("path"))).collect()
    assert len(rows) == len(set(rows))
    for s, t in ends:
        assert {r[1] for r in rows if r[0] == f"{s}-{t}"} == (brute(EDGES, s, t, length) if s != t else set())


def test_reverse_and_limits(spark):
    e = spark.createDataFrame(EDGES, "s string, p string, o string")
    pairs = search.pairs_of(spark, [("a", "e"), ("e", "a")])
    p = search.find_paths(pairs, e, SearchConfig(length=4))
    fwd = {r[0] for r in p.where("pair_id = 'a-e'").select(paths.text(F.col("path"))).collect()}
    back = {r[0] for r in p.where("pair_id = 'e-a'").select(paths.text(paths.reverse(F.col("path")))).collect()}
    assert fwd and fwd == back
    assert search.find_paths(pairs, e, SearchConfig(length=4, ignored_properties=("P4",))).count() == 0
    assert search.find_paths(pairs, e, SearchConfig(length=4, ignored_nodes=("c",))).count() == 0
    with pytest.raises(ValueError):
        search.find_paths(pairs, e, SearchConfig(length=4, max_rows=1)).count()
    domain = spark.createDataFrame([("b",), ("c",), ("d",), ("e",)], "node string")
    assert search.find_paths(search.pairs_of(spark, [("a", "e")]), e, SearchConfig(length=4), domain).count() > 0
    assert search.find_paths(search.pairs_of(spark, []), e).count() == 0


def test_views_from_the_fixtures(spark):
    df = spark.createDataFrame([("1", "a P1 b P2@ c".split(), 2), ("2", ["a"], 0), ("3", "a P1 b P2 a".split(), 2)], "pair_id string, path array<string>, len int")
    p = F.col("path")
    got = df.select(paths.text(paths.reverse(p)), paths.properties(p), paths.is_simple(p)).collect()
    assert got[0][0] == "c P2 b P1@ a" and got[0][1] == ["P1", "P2@"] and got[0][2] and not got[2][2]
    assert paths.path_edges(df).where("pair_id = '2'").count() == 0
    pp = spark.createDataFrame([("1", "a P1 b P2 c P1 d".split(), 3)], "pair_id string, path array<string>, len int")
    assert [tuple(r) for r in paths.property_pairs(pp).collect()] == [("P1", "P2")]


def test_support(spark):
    df = spark.createDataFrame([("1", "x P1 a P2 b P3 y".split(), 3), ("1", "x P1 a P2 c P3 y".split(), 3), ("1", "x P9 y".split(), 1)], "pair_id string, path array<string>, len int")
    got = {r.pattern: (r.instances, r.min_support) for r in patterns.min_support(df).collect()}
    assert got == {"P1 P2 P3": (2, 1), "P9": (1, 1)}


@pytest.mark.parametrize("a,b,want", [("P1 P2 P3", "P1 P4 P3", {(1, 1), (3, 3)}), ("P1 P2 P3", "P2 P1 P3", {(3, 3)}), ("P1 P2 P2 P3", "P4 P2 P2 P5", {(2, 2), (2, 3), (3, 2), (3, 3)})])
def test_overlap(spark, a, b, want):
    f = spark.createDataFrame([(a, a.count(" ") + 1), (b, b.count(" ") + 1)], "pattern string, size int")
    pairs = spark.createDataFrame([(a, b)], "pattern_a string, pattern_b string")
    assert {(r.pos_a, r.pos_b) for r in patterns.overlap(pairs, f).collect()} == want


def test_pairs_and_overlap_of_all_patterns(spark, monkeypatch):
    """More patterns than a page of 50, by brute force; equal frequencies in the order of the text."""
    from itertools import combinations

    from pathweave.suite import graphs

    freq = [(" ".join(f"P{(k * i) % 17}" for i in range(1, n + 1)), n, k % 5) for n in (1, 2, 3) for k in range(1, 31)]
    freq = list({p: (p, n, c) for p, n, c in freq}.values())
    monkeypatch.setattr(graphs, "_mined", lambda s, d: None)
    monkeypatch.setattr(patterns, "frequency", lambda _: spark.createDataFrame(freq, "pattern string, size int, instances long"))
    order = [p for p, n, c in sorted(freq, key=lambda x: (-x[2], x[0])) if n > 1]
    pairs = set(combinations(order, 2))
    got = [tuple(r) for r in graphs.pattern_pairs(spark, "").collect()]
    assert len(order) > 30 and len(freq) > 50 and len(got) == len(pairs) and set(got) == pairs
    end = lambda k, x: "both" if len(x) == 1 else "first" if k == 0 else "last" if k == len(x) - 1 else "inner"
    want = {(a, i + 1, b, j + 1) for a, b in pairs for x, y in [(a.split(), b.split())] for i, p in enumerate(x) for j, q in enumerate(y) if p == q and end(i, x) == end(j, y)}
    rows = [tuple(r) for r in graphs.pattern_overlap(spark, "").select("pattern_a", "pos_a", "pattern_b", "pos_b").collect()]
    assert want and len(rows) == len(want) and set(rows) == want
