import random
from itertools import combinations

import numpy as np
import pytest

from pathweave.llm import subsequences as q


def holds(seq, pat):
    it = iter(seq)
    return all(x in it for x in pat)


def brute(seqs, least):
    every = {c for s in seqs for n in range(1, len(s) + 1) for c in combinations(s, n)}
    sup = {p: sum(holds(s, p) for s in seqs) for p in every}
    sup = {p: n for p, n in sup.items() if n >= least}
    closed = {p: n for p, n in sup.items() if not any(m == n and len(o) == len(p) + 1 and holds(o, p) for o, m in sup.items())}
    return sup, closed


@pytest.mark.parametrize("seed", range(6))
def test_against_all_subsequences(spark, seed):
    r = random.Random(seed)
    alphabet = "ABCDE"[: r.randint(2, 5)]
    seqs = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 7))) for _ in range(25)]
    df = spark.createDataFrame([("x", list(s)) for s in seqs], "origin string, seq array<string>")
    sup, closed = brute(seqs, 4)
    got = q.closed_patterns(df, 0.01, 4)
    rows = {tuple(r.pattern): r.support for r in got.collect()}
    assert rows == closed
    back = {tuple(r.pattern.split()): r.support for r in q.recover(got, 1, 7).collect()}
    assert back == sup


def periods(seq, prefix):
    """Items of the maximum and of the semi-maximum periods, by the definition."""
    first, p = [], -1
    for e in prefix:
        p = seq.index(e, p + 1)
        first.append(p)
    starts = [0] + [x + 1 for x in first[:-1]]

    def backward(end):
        at = []
        for e in reversed(prefix):
            end -= 1
            while seq[end] != e:
                end -= 1
            at.append(end)
        return at[::-1]

    last, semi = backward(len(seq)), backward(first[-1] + 1)
    return [set(seq[a:b]) for a, b in zip(starts, last)], [set(seq[a:b]) for a, b in zip(starts, semi)]


def test_block_against_definition():
    r = random.Random(9)
    for _ in range(60):
        n_items = r.randint(1, 4)
        seqs = [[r.randrange(n_items) for _ in range(r.randint(1, 7))] for _ in range(r.randint(1, 5))]
        w = [r.randint(1, 3) for _ in seqs]
        prefixes = {c for s in seqs for n in (1, 2, 3) for c in combinations(s, n)} | {(0, 0, 0, 0)}
        got = set(q.block_counts(*q.pack([(np.array(s, "<i4").tobytes(), n) for s, n in zip(seqs, w)]), n_items, sorted(prefixes)))
        want = set()
        for p in prefixes:
            mine = [(s, k) for s, k in zip(seqs, w) if holds(s, p)]
            if not mine:
                continue
            sup = sum(k for _, k in mine)
            want.add((p, "P", 0, -1, sup))
            for e in range(n_items):
                if n := sum(k for s, k in mine if holds(s, (*p, e))):
                    want.add((p, "F", 0, e, n))
            for kind in (0, 1):
                each = [periods(s, list(p))[kind] for s, _ in mine]
                want |= {(p, "MS"[kind], i, e, sup) for i in range(len(p)) for e in set.intersection(*[x[i] for x in each])}
        assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_small_blocks_parts_and_prefix_groups(spark, seed, monkeypatch):
    monkeypatch.setattr(q, "CELLS", 60)
    monkeypatch.setattr(q, "PART_ROWS", 5)
    monkeypatch.setattr(q, "PREFIXES", 3)
    monkeypatch.setattr(q, "FLUSH", 7)
    r = random.Random(seed + 50)
    seqs = ["".join(r.choice("ABCD") for _ in range(r.randint(1, 6))) for _ in range(30)]
    df = spark.createDataFrame([("x", list(s)) for s in seqs], "origin string, seq array<string>")
    sup, closed = brute(seqs, 4)
    got = q.closed_patterns(df, 0.01, 4)
    assert {tuple(r.pattern): r.support for r in got.collect()} == closed
    assert {tuple(r.pattern.split()): r.support for r in q.recover(got, 1, 6).collect()} == sup


def test_origins_repeats_and_nulls(spark):
    a = spark.createDataFrame([(1, ["p1 ", None, "P2"], 0), (1, ["p1 ", None, "P2"], 0), (2, [" ", None], 0), (3, None, 0), (4, [], 0), (5, ["P1", "P2"], 0)], "id long, lst array<string>, seq int")
    b = spark.createDataFrame([(1, " p1\tP2\n"), (2, None), (3, "  "), (4, "P2 P1")], "id long, t string")
    seqs = q.from_lists(a, "id", "lst", "a").unionByName(q.from_text(b, "id", "t", "b"))
    assert seqs.count() == 4
    got = {(r.origin, " ".join(r.pattern), r.support) for r in q.closed_patterns(seqs, 0.5, 2).collect()}
    assert got == {("a", "P1 P2", 2), ("b", "P1", 2), ("b", "P2", 2)}


def test_empty_and_none_frequent(spark):
    df = spark.createDataFrame([], "origin string, seq array<string>")
    assert q.closed_patterns(df, 0.02, 5).count() == 0
    one = spark.createDataFrame([("x", ["A"])], "origin string, seq array<string>")
    assert q.closed_patterns(one, 0.02, 5).count() == 0


def test_hot_item_and_long_sequence(spark):
    seqs = [["H", "A"]] * 40 + [["H", "B"]] * 40 + [["X"] * 300 + ["H"]] * 5
    df = spark.createDataFrame([("x", s) for s in seqs], "origin string, seq array<string>")
    got = {" ".join(r.pattern): r.support for r in q.closed_patterns(df, 0.2, 5).collect()}
    assert got == {"H": 85, "H A": 40, "H B": 40}
