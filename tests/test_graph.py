from pyspark.sql import functions as F

from pathweave.operators import graph, stats
from pathweave.streaming import incremental


def test_dictionary_is_dense(spark):
    df = spark.createDataFrame([(f"t{i % 97:03d}",) for i in range(500)] + [(None,)], "term string")
    got = {r.term: r.code for r in graph.dictionary(df, "term", partitions=5).collect()}
    assert got == {t: f"u{k}" for k, t in enumerate(sorted({f"t{i:03d}" for i in range(97)}), 1)}
    assert graph.dictionary(df.where("false"), "term").count() == 0


def test_keep_first_and_toggle(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("a", "y", 3), ("b", None, 1), (None, "z", 1)], "k string, v string, t int")
    assert {tuple(r) for r in graph.keep_first(df, "k", "v", "t", "none").collect()} == {("a", "x"), ("b", "none")}
    assert spark.range(1).select(graph.toggle(F.lit("P1")), graph.toggle(F.lit("P1@"))).first()[:] == ("P1@", "P1")


def test_pair_counts_without_walks(spark):
    t = spark.createDataFrame([("a", "p", "m"), ("b", "p", "m"), ("m", "q", "x"), ("m", "q", "y"), ("m", "q", "z")], "s string, p string, o string")
    pairs = spark.createDataFrame([("p", "q"), ("q", "p"), ("q", "q@")], "p1 string, p2 string")
    got = {(r.p1, r.p2): r.n for r in stats.property_pair_counts(graph.with_inverse(t), pairs).collect()}
    assert got == {("p", "q"): 6, ("q", "p"): 0, ("q", "q@"): 3}


def test_streamed_counts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", "p", "b"), ("a", "q", "c"), ("b", "p", None)]
    for _ in range(2):
        spark.createDataFrame(rows, "s string, p string, o string").write.mode("append").parquet(src)
        q = incremental.start(spark.readStream.schema("s string, p string, o string").parquet(src), out, str(tmp_path / "ck"))
        q.awaitTermination()
    got = {(r.kind, r.key): r.n for r in incremental.current(spark, out).collect()}
    assert got["s", "a"] == 4 and got["sp", "a p"] == 2 and ("s", "b") not in got
