from collections import Counter

from pyspark.sql import functions as F

from pathweave.operators import skew


def test_tree_equals_plain_grouping(spark):
    rows = [(None if i % 11 == 0 else 1 if i % 3 else i % 7, i % 13 if i % 5 else None, "k") for i in range(5000)]
    df = spark.createDataFrame(rows, "key long, node long, n_rows string").repartition(40)
    got = {r.key: (r.n_rows, r.n_entities) for r in skew.key_profile(df, "key", "node", fan_in=3).collect()}
    n = Counter(k for k, _, _ in rows if k is not None)
    d = {k: len({x for q, x, _ in rows if q == k and x is not None}) for k in n}
    assert got == {k: (n[k], d[k]) for k in n}
    one = skew.tree_aggregate(df, ["key"], {"n": (F.lit(1), "sum"), "lo": (F.col("node"), "min"), "hi": (F.col("node"), "max")}, fan_in=2)
    assert {r.key: r.n for r in one.collect()} == Counter(k for k, _, _ in rows)


def test_no_reducer_gets_all_partials(spark):
    df = spark.range(0, 1000, 1, 64).select(F.lit(1).alias("key"), "id")
    plan = skew.tree_aggregate(df, ["key"], {"n": (F.lit(1), "sum")}, fan_in=4, chunks=64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3  # 64 chunks, 4 at a time


def test_heavy_keys(spark):
    a = spark.createDataFrame([(1,)] * 50 + [(2,)] * 30 + [(i,) for i in range(10, 30)] + [(None,)] * 100, "size int")
    got = {(r.field, r.key_value, r.n_rows) for r in skew.heavy_keys({"a": a, "empty": a.where("false")}, 0.03, 2).collect()}
    assert got == {("a", "1", 50), ("a", "2", 30)}
    assert skew.key_profile(a.withColumn("e", F.col("size")).where("false"), "size", "e").count() == 0


def test_nothing_runs_while_planning(spark):
    from pathweave import suite

    spark.sparkContext.setJobGroup("planning", "")
    try:
        for name in ("p3_found", "p3_wobject_keys", "p3_client_keys"):
            suite.queries()[name](spark, "/root/testdata/sf0.001")  # opens the tables: their schemas are known afterwards
        spark.sparkContext.setJobGroup("planned", "")
        for name in ("p3_found", "p3_wobject_keys", "p3_client_keys"):
            suite.queries()[name](spark, "/root/testdata/sf0.001")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planned")
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_any_number_of_expected_chunks(spark):
    df = spark.range(0, 1000, 1, 40).select((F.col("id") % 7).alias("key"))
    for chunks in (1, 5, 40, 5000):
        got = skew.tree_aggregate(df, ["key"], {"n": (F.lit(1), "sum")}, fan_in=3, chunks=chunks)
        assert {r.key: r.n for r in got.collect()} == Counter(k % 7 for k in range(1000))


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(skew, "BUCKET_ROWS", 7)
    df = spark.createDataFrame([(k * 3, "ab"[k % 3 == 0], k % 5) for k in range(100)], "slot long, source string, m long")
    for by in ([], ["source"]):
        got = {r.slot: r.s for r in skew.running(df, by, "slot", "m", "s").collect()}
        sums: dict = {}
        for r in sorted(df.collect()):
            key = r.source if by else ""
            sums[key] = sums.get(key, 0) + r.m
            assert got[r.slot] == sums[key]
