import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from pathweave.llm import ledger


def want_of(rows, seen=None):
    seen, out = set() if seen is None else seen, {}
    for i, k in sorted(r for r in rows if r[0] is not None):
        if k is not None:
            out[i] = k in seen
            seen.add(k)
    return out


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_against_a_set(spark, batches, monkeypatch):
    monkeypatch.setattr(ledger, "BLOCK", 32)
    monkeypatch.setattr(ledger, "FAN", 3)
    r = random.Random(batches)
    rows = [(i * 3 - 200, r.choice([None, "hot", "hot", f"k{r.randint(0, 40)}", f"u{i}"])) for i in range(600)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, key string")
    want = want_of(rows)
    assert {x.id: x.seen for x in ledger.stream(df, batches).collect()} == want
    a = ledger.audit(df, batches).first()
    n = sum(want.values())
    assert (a.n_rows, a.n_null, a.n_new, a.n_repeat, a.n_wrong, a.wrong_rate) == (600, sum(k is None for _, k in rows), len(want) - n, n, 0, 0.0)


def test_later_batches_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "FAN", 2)
    r, seen, path = random.Random(4), set(), f"file://{tmp_path}/l"
    for b in range(5):
        rows = [(b * 1000 + i, f"k{r.randint(0, 300)}") for i in range(200)]
        want = want_of(rows, seen)
        book = ledger.Ledger(spark, path)  # opened anew for every batch
        df = spark.createDataFrame(rows, "id long, key string")
        assert {x.id: x.seen for x in book.feed(df, f"b{b}").collect()} == want
        assert {x.id: x.seen for x in book.feed(df, f"b{b}").collect()} == want  # fed again: the same answers
        assert {x.key for x in ledger.Ledger(spark, path).keys().collect()} == seen and book.keys().count() == len(seen)
        assert len(book.state["generations"]) <= 3
        book.vacuum(forget=(f"b{b}",))
        assert book.keys().count() == len(seen)
    with pytest.raises(RuntimeError):
        old = ledger.Ledger(spark, path)
        book.feed(df, "again")
        old.feed(df, "other")


def test_another_process_knows_the_keys(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    code = f"""
from pyspark.sql import SparkSession
from pathweave.llm.ledger import Ledger
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{tmp_path}/w").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
print(Ledger(s, "{path}").feed(s.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, key string"), "first").where("seen").collect())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    assert "id=3" in out.stdout, out.stderr[-2000:]
    book = ledger.Ledger(spark, path)
    assert book.state["buckets"] == 3
    got = book.feed(spark.createDataFrame([(4, "a"), (5, "c"), (6, "c"), (7, None)], "id long, key string"), "second").collect()
    assert {x.id: x.seen for x in got} == {4: True, 5: False, 6: True}


def test_history_is_merged_without_moving_it(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/l")
    df = spark.range(2000).select("id", F.concat(F.lit("k"), F.col("id") % 700).alias("key"))
    book.feed(df, "a")
    names = book._tables()
    heads = df.groupBy("key").agg(F.min("id").alias("id"))
    plan = heads.join(spark.table(names[0]).where("not seen").hint("merge"), "key", "left")._jdf.queryExecution().executedPlan().toString()
    history = plan[plan.index("FileScan") - 400 :]
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(key") == 1 and "Bucketed: true" in history


def test_keys(spark):
    df = spark.createDataFrame([(1, " a  b\n"), (1, "a b"), (2, "a b"), (1, "A b"), (1, None), (1, " \t"), (None, "a b")], "s long, t string")
    k = [r[0] for r in df.select(ledger.text_key("s", "t")).collect()]
    assert k[0] == k[1] and len({k[0], k[2], k[3], k[6]}) == 4 and k[4] is None and k[5] is None


def test_empty_repeated_and_clashing_names(spark):
    df = spark.createDataFrame([], "id long, key string")
    assert ledger.repeats(df).count() == 0 and ledger.audit(df).first().n_wrong == 0
    extra = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "a"), (None, "a")], "id long, key string").withColumn("block", F.lit(9)).withColumn("batch", F.lit("x")).withColumn("r", F.lit(0))
    assert [r.id for r in ledger.repeats(extra).collect()] == [2]
