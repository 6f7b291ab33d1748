import random

import pytest
from pyspark.sql import functions as F

from pathweave.config import SearchConfig
from pathweave.operators import graph, search
from pathweave.plans import bgp
from pathweave.session import bucketed, clean, cut


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    r = random.Random(7)
    rows = sorted({(f"n{r.randint(0, 12)}", f"P{r.randint(1, 3)}", f"n{r.randint(0, 12)}") for _ in range(60)})
    df = spark.createDataFrame(rows, "s string, p string, o string")
    path = f"file://{tmp_path_factory.mktemp('graph')}"
    graph.save(df, path)
    return df, graph.load(spark, path), rows


def test_round_trip_and_pruning(both):
    df, st, rows = both
    for t in (st.by_subject, st.by_object):
        assert sorted(map(tuple, t.collect())) == rows
    near = {tuple(x) for x in st.around(["n1", "n2"]).collect()}
    assert near == {(s, p, o) for s, p, o in rows if s in ("n1", "n2")} | {(o, p + "@", s) for s, p, o in rows if o in ("n1", "n2")}
    plan = st.by_object.where("p = 'P1' and o = 'n3'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "EqualTo(o,n3)" in plan


def test_search_is_the_same(spark, both):
    df, st, _ = both
    pairs = search.pairs_of(spark, [("n0", "n5"), ("n3", "n9"), ("n1", "n1")])
    for cfg in (SearchConfig(length=3), SearchConfig(length=3, ignored_properties=("P2",), max_links=9)):
        a, b = ({(r.pair_id, " ".join(r.path)) for r in search.find_paths(pairs, e, cfg).collect()} for e in (df, st))
        assert a == b and a


@pytest.mark.parametrize("how", [{}, {"cycles": 1}, {"cycles": 2, "ignored_properties": ("P3",), "ignored_objects": ("n4",)}])
def test_shared_walks_give_what_each_template_gives(both, how):
    df, st, _ = both
    qs = bgp.templates("n0", "n5", 4, **how)
    assert len(qs) == 20
    alone = sorted(tuple(r) for q in qs for r in bgp.as_paths(q, bgp.evaluate(q, df)).collect())
    for t in (df, st):
        assert sorted(tuple(r) for r in bgp.relate(qs, t).collect()) == alone
    assert alone


def test_pagerank_and_hubs(spark, both, monkeypatch):
    df, st, rows = both
    monkeypatch.setattr(graph, "HUB_LINKS", 2)  # links of a node lie in several buckets
    nodes = {x for s, _, o in rows for x in (s, o)}
    deg = {n: sum(s == n for s, _, _ in rows) for n in nodes}
    want = dict.fromkeys(nodes, 1.0)
    for _ in range(3):
        want = {n: 0.15 + 0.85 * sum(want[s] / deg[s] for s, _, o in rows if o == n) for n in nodes}
    got = {r.node: r.score for r in graph.pagerank(st.by_subject).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in nodes)
    assert graph.pagerank(df.where("false")).count() == 0


def test_buckets_are_not_moved(spark):
    a = bucketed(spark.range(1000).select((F.col("id") % 50).alias("k"), "id"), "k")
    plan = a.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and a.groupBy("k").count().count() == 50
    assert cut(a).count() == 1000
    clean(spark)
