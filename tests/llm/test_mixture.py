import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pathweave.llm import mixture as m


def test_schedule_stays_within_a_block():
    r = random.Random(5)
    for _ in range(40):
        blocks = {f"s{k}": r.randint(0, 60) for k in range(r.randint(1, 7))}
        order = m.schedule(blocks)
        assert sorted(s for s, _, _ in order) == sorted(s for s, n in blocks.items() for _ in range(n))
        assert [t for _, _, t in order] == list(range(len(order)))
        for s in blocks:
            assert [k for x, k, _ in order if x == s] == list(range(blocks[s]))
        if order:
            assert max(m.max_lag(order, blocks).values()) < 1


def test_quotas():
    t = [{"source": "a", "target_share": 0.5, "max_repeat": 1}, {"source": "b", "target_share": 0.3, "max_repeat": 4}, {"source": "c", "target_share": 0.2, "max_repeat": 2}]
    q = m.quotas(t, {"a": 1000, "b": 50})
    assert q == {"a": Fraction(1000, 3), "b": Fraction(200), "c": 0} and q["a"] / q["b"] == Fraction(5, 3)
    assert m.quotas(t, {}) == {"a": 0, "b": 0, "c": 0}
    q = m.quotas(t, {"a": 1000, "b": 50}, total=1600)
    assert q["b"] == 200 and q["a"] == 1000


def test_offsets(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 5}", i % 7 + 1) for i in range(400)], "id long, source string, n_tokens long")
    rows = m.offsets(df, 300).collect()
    for s in {r.source for r in rows}:
        mine = sorted((r.start, r.n_tokens) for r in rows if r.source == s)
        at = 0
        for start, n in mine:
            assert start == at
            at += n


def test_mix(spark):
    r = random.Random(1)
    docs = [(i, r.choice(["Big-One", "big_one ", "BIG ONE", "small"]) if i % 10 else "small", " ".join(["word"] * r.randint(0, 60)), "x") for i in range(400)]
    docs += [(1000, None, "text", "x"), (1001, "small", None, "x"), (1002, "other", "text", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, slot string")
    target = spark.createDataFrame([("big_one", 0.2, 1), ("small", 0.7, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeat int")
    mix, report = m.mix(df, target)
    rows = mix.collect()
    uses = {}
    for x in rows:
        uses[x.doc_id] = uses.get(x.doc_id, 0) + 1
    by = {r.source: r for r in report.collect()}
    total = sum(x.n_tokens for x in rows)
    for s, want in (("big_one", 0.2 / 0.9), ("small", 0.7 / 0.9)):
        got = sum(x.n_tokens for x in rows if x.source == s) / total
        assert abs(got - want) < 0.01 and abs(by[s].reached_share - got) < 1e-9
        assert max(uses[x.doc_id] for x in rows if x.source == s) <= by[s].max_repeat and by[s].max_lag_blocks < 1
    assert by["none"].reached_share == 0 and by["none"].n_docs == 0
    # the measured distance in tokens, by going through the mixture
    order = sorted(rows, key=lambda x: (x.slot, x.block_start))
    end = min(max(x.slot for x in rows if x.source == s) for s in ("big_one", "small"))
    for s, w in (("big_one", 0.2 / 0.9), ("small", 0.7 / 0.9)):
        own = every = worst = 0
        for slot in sorted({x.slot for x in order if x.slot <= end}):
            mine = [x for x in order if x.slot == slot]
            assert len({x.source for x in mine}) == 1
            every += sum(x.n_tokens for x in mine)
            own += sum(x.n_tokens for x in mine if x.source == s)
            worst = max(worst, abs(own - w * every))
        assert abs(by[s].max_lag_tokens - worst) <= 0.1 and worst <= m.BLOCK + 2 * 60
    assert len({(x.doc_id, x.use_no) for x in rows}) == len(rows)
    assert m.mix(df.where("false"), target)[0].count() == 0


def test_the_schedule_repeats_and_capped_sources_run_out(spark):
    docs = spark.createDataFrame([(i, s, "word " * 50) for i, s in enumerate(["a"] * 2000 + ["b"] * 40 + ["c"] * 800)], "doc_id long, source string, text string")
    target = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.25, 2)], "source string, target_share double, max_repeat int")
    mix, report = m.mix(docs, target, total=100_000)
    by = {r.source: r for r in report.collect()}
    assert by["b"].most_uses == 2 and by["b"].n_uses == 80 and by["a"].tokens_used > 45_000 and by["c"].tokens_used > 22_000
    slots = {}
    for r in mix.collect():
        slots.setdefault(r.slot, set()).add(r.source)
    assert all(len(x) == 1 for x in slots.values())
    for s, w in (("a", 0.5), ("c", 0.25)):
        mine = sorted(k for k, x in slots.items() if s in x)
        for n, k in enumerate(mine, 1):
            assert abs(n - w * (k + 1)) < 1 and abs(n - 1 - w * k) < 1


def test_token_counts(spark):
    enc = m.encoder()
    text = "Die Aussprache ist geschlossen – l'été, 12.5 % <|endoftext|>"
    df = spark.createDataFrame([(1, text, "a"), (2, "x" * 200_000, "a")], "doc_id long, text string, source string")
    got = {r.id: r.n_tokens for r in m.count_tokens(df).collect()}
    assert got[1] == len(enc.encode_ordinary(text)) and enc.decode(enc.encode_ordinary(text)) == text and got[2] > 1000


@pytest.mark.parametrize("x,want", [(" A-b C ", "a_b_c"), ("  ", None), (None, None)])
def test_sources(spark, x, want):
    assert spark.createDataFrame([(x,)], "s string").select(m.clean_source(F.col("s"))).first()[0] == want
