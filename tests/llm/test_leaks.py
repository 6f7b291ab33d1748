import random

from pathweave.llm import leaks

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_words():
    assert leaks.words("Émile's vil-\r\n lage, STRASSE/Straße co-op") == ["emile", "s", "village", "strasse", "strasse", "co", "op"]
    assert leaks.words("") == [] and leaks.words("… – !") == []
    assert leaks.words("vil-\nlage vil- lage") == ["village", "vil", "lage"]


def test_against_all_runs():
    r = random.Random(3)
    for _ in range(60):
        voc = "abcdefg"[: r.randint(2, 7)]
        items = [(i, " ".join(r.choice(voc) for _ in range(r.randint(3, 14)))) for i in range(5)]
        doc = " ".join(r.choice(voc + "z") for _ in range(200))
        run = r.choice([4, 5, 7])
        w = doc.split()
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        want = {i for i, t in items if any(tuple(t.split()[k : k + run]) in grams for k in range(len(t.split()) - run + 1))}
        slots, groups, own = {}, {}, {}
        for i, t in items:
            for b, s in leaks.shifts(t.split(), run).items():
                slots[b] = min(s, slots.get(b, run))
            for x in leaks.strings(t.split(), run):
                own.setdefault(x, set()).add(i)
                h = leaks.bit(x, 1 << 16)
                groups[h >> 5] = groups.get(h >> 5, 0) | 1 << (h & 31)
        found = list(leaks.WuManber(list(slots.items()), list(groups.items()), 1 << 16, run).windows(doc))
        assert {i for _, x in found for i in own.get(x, ())} == want
        ends = [at for at, x in found if x in own]
        assert ends == [k + run for k in range(len(w) - run + 1) if " ".join(w[k : k + run]) in own]


def test_frames(spark):
    docs = spark.createDataFrame(
        [(1, f"x {ITEM.upper()} y"), (2, ITEM.replace("six", "six-\nteen")), (3, None), (4, ""), (5, "one, two; three – four five six\nseven eight nine ten eleven TWELVE."), (5, "one, two; three – four five six\nseven eight nine ten eleven TWELVE."), (6, "two " * 200_000 + ITEM), (7, ITEM.replace("seven", "word seven"))],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(9, ITEM), (9, ITEM), (8, ITEM + " end"), (7, "too short"), (6, None)], "item_id long, text string")
    want = {(1, 9), (1, 8), (5, 9), (5, 8), (6, 9), (6, 8)}
    got = leaks.find_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    assert {tuple(r) for r in leaks.leaked(docs, items).collect()} == want
    assert {tuple(r) for r in leaks.too_short(items).collect()} == {(7, 2), (6, 0)}
    assert {r.n_words for r in leaks.find_leaks(docs, items).where("doc_id = 1").collect()} == {14}
    assert leaks.find_leaks(docs.where("false"), items).count() == 0 and leaks.find_leaks(docs, items.where("false")).count() == 0


def test_one_scan_of_the_corpus_for_many_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_BITS", 1 << 16)  # as if there were far more items than bits
    r = random.Random(8)
    voc = [f"w{k}" for k in range(60)]
    texts = [" ".join(r.choice(voc) for _ in range(40)) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(k, "so " + " ".join(texts[k * 7].split()[5:18]) + " and " + texts[k * 7 + 1]) for k in range(30)], "doc_id long, text string")
    want = {(k, i) for k in range(30) for i in (k * 7, k * 7 + 1)}
    out = leaks.find_leaks(docs, items)
    assert {(x.doc_id, x.item_id) for x in out.collect()} == want and {x.n_words for x in out.collect()} == {13, 40}
    plan = leaks.leaked(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas scan") == 1
