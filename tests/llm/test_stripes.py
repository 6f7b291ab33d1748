import math
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from pathweave.llm import stripes


def test_against_pairs(spark, monkeypatch):
    r = random.Random(2)
    recs = [(i, [r.choice([None, " ", "p1 ", "P1", "P2", "p3", "P4", "P5"]) for _ in range(r.randint(0, 6))] if i % 9 else None) for i in range(300)]
    recs += recs[:40]
    df = spark.createDataFrame([(i, x, "n") for i, x in recs], "id long, lst array<string>, n string")
    sets = {i: {c.strip().upper() for c in x if c and c.strip()} for i, x in recs if x}
    sets = {i: s for i, s in sets.items() if s}
    one = Counter(c for s in sets.values() for c in s)
    two = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    for flush, size in ((1_000_000, 4096), (5, 2)):
        monkeypatch.setattr(stripes, "FLUSH", flush)
        monkeypatch.setattr(stripes, "SLICE", size)
        got = {(r.a, r.b): (r.n_ab, r.n_a, r.n_b, r.n) for r in stripes.cooccurrence(stripes.records(df, "id", "lst")).collect()}
        assert got == {p: (n, one[p[0]], one[p[1]], len(sets)) for p, n in two.items()}


def test_likelihood(spark):
    row = spark.createDataFrame([(10, 12, 15, 100), (1, 50, 50, 100), (5, 5, 5, 5)], "n_ab long, n_a long, n_b long, n long")
    got = [r[0] for r in row.select(stripes.log_likelihood()).collect()]

    def g2(ab, a, b, n):
        cells = [(ab, a * b), (a - ab, a * (n - b)), (b - ab, (n - a) * b), (n - a - b + ab, (n - a) * (n - b))]
        return 2 * sum(k * math.log(k * n / e) for k, e in cells if k)

    assert math.isclose(got[0], g2(10, 12, 15, 100)) and math.isclose(got[1], -g2(1, 50, 50, 100)) and got[2] == 0


def test_level(spark):
    rows = spark.createDataFrame([(5, 5, 1000, 3000), (20, 60, 100, 1000), (3, 50, 60, 1000)], "n_ab long, n_a long, n_b long, n long")
    g = [r[0] for r in rows.select(stripes.log_likelihood()).collect()]
    for level, limit in ((0.05, 3.841459), (0.001, 10.827566)):
        assert [r[0] for r in rows.select(stripes.significant(level)).collect()] == [x > limit for x in g]
    assert 10.9 < g[0] < 11.1 and g[1] > 10.9 and abs(g[2]) < 3.8  # least that is found: a pair three times as frequent as by chance
    worst = spark.createDataFrame([(5, a, b, 3 * a * b // 5) for a in range(5, 60) for b in range(5, 60) if 3 * a * b // 5 <= 2500 and a * b * 3 % 5 == 0], "n_ab long, n_a long, n_b long, n long")
    assert worst.where(~stripes.significant(0.05) & (F.col("n") >= F.col("n_a") + F.col("n_b") - 5)).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "id long, lst array<string>")
    assert stripes.cooccurrence(stripes.records(df, "id", "lst")).count() == 0
