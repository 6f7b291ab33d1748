import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from pathweave.llm import pii
from pathweave.llm.tagger import Tagger

GIVEN = ["Marit", "Olwen", "Per-Arne", "Zdenka", "Élie"]


def numeric(f, a, at, eps=1e-3):
    old = a[at]
    a[at] = old + eps
    hi = f()
    a[at] = old - eps
    lo = f()
    a[at] = old
    return (hi - lo) / 2 / eps


def test_gradients():
    t = Tagger(["a", "b"], "abcdefgh", hidden=5)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    rng = np.random.default_rng(0)
    sym, tags = rng.integers(6, 14, (3, 8)), np.zeros((3, 8), int)
    tags[0, 2:4], tags[1, 4], tags[2, 0] = (1, 2), 3, 1
    valid = np.ones((3, 8), bool)
    valid[1, 6:] = False
    g = t.loss(sym, tags, valid)[1]
    for k in g:
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in t.p[k].shape)
            assert abs(g[k][at] - numeric(lambda: t.loss(sym, tags, valid)[0], t.p[k], at)) < 1e-5


def test_viterbi_is_best():
    from itertools import product

    t = Tagger(["a"], "ab", hidden=4)
    rng = np.random.default_rng(1)
    t.p["t"], t.p["s"] = rng.standard_normal((3, 3)).astype(np.float32), rng.standard_normal(3).astype(np.float32)
    es = [rng.standard_normal((n, 3)).astype(np.float32) for n in (5, 3, 1)]
    for e, got in zip(es, t.viterbi(es)):
        def score(p):
            if p[0] == 2 or any(b == 2 and a == 0 for a, b in zip(p, p[1:])):
                return -1e9
            return t.p["s"][p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(t.p["t"][a, b] for a, b in zip(p, p[1:]))

        assert tuple(got) == max(product(range(3), repeat=len(e)), key=score)


def test_windows_do_not_matter_much():
    t = pii.pretrained()
    text = "I thank Mrs Quiverholt for that remark. " * 60
    a, b = t.tag([text], window=256)[0], t.tag([text], window=200, overlap=64)[0]
    assert (a == b).mean() > 0.99


CASES = [
    ("Please write to marit.quiverholt@lanternpost.example before Friday.", "email", "marit.quiverholt@lanternpost.example"),
    ("Replies should go to zquill [at] lanternpost [dot] test.", "email", "zquill [at] lanternpost [dot] test"),
    ("Call +999 21 555 08 13, if you doubt me.", "phone", "+999 21 555 08 13"),
    ("Tel. (031) 555-2210", "phone", "(031) 555-2210"),
    ("Wer betroffen ist, ruft 061 555 2210 ext. 14 an.", "phone", "061 555 2210 ext. 14"),
    ("The passport, PK 310 4421, was never returned.", "id_number", "PK 310 4421"),
    ("Le dossier porte le numéro personnel 190448-2210K.", "id_number", "190448-2210K"),
    ("The house at Flat 4, 12 Copper Row, 4410 Quillmoor has been empty since the flood.", "address", "Flat 4, 12 Copper Row, 4410 Quillmoor"),
    ("La maison sise 12 bis, rue des Lanternes, 4410 Quillmoor est vide depuis la crue.", "address", "12 bis, rue des Lanternes, 4410 Quillmoor"),
    ("Das Haus Lampenweg 12a, 4410 Quillmoor steht seit der Flut leer.", "address", "Lampenweg 12a, 4410 Quillmoor"),
    ("I thank Mrs Quiverholt for that remark.", "name", "Quiverholt"),
    ("The witness Marit S. Quiverholt was heard by the committee.", "name", "Marit S. Quiverholt"),
    ("My office has been helping Quiverholt, Marit since the spring.", "name", "Quiverholt, Marit"),
    ("Je remercie M. Quiverholt de cette remarque, et la commission aussi.", "name", "Quiverholt"),
    ("The report by Olwen QUIVERHOLT is before you and the house.", "name", "Olwen QUIVERHOLT"),
]


def test_spans_by_form():
    texts = [c[0] for c in CASES]
    found = pii.detect(pii.pretrained(), texts, frozenset(GIVEN))
    right = sum((kind, x) in {(k, t[a:b]) for a, b, k in s} for (t, kind, x), s in zip(CASES, found))
    assert right >= len(CASES) - 1, [(c, s) for c, s in zip(CASES, found) if (c[1], c[2]) not in {(k, c[0][a:b]) for a, b, k in s}]


def test_what_is_no_case():
    texts = ["See document B-971/2005 and petition 9081/2020.", "Budget line 04 02 31 00 was cut to 35.49 million.", "The interest was charged @ 45 per cent, rule 12.14(b).", "Standing order 83, section 66, paragraph 23 applies.", "", None]
    assert pii.detect(pii.pretrained(), texts) == [[]] * 6


def test_redaction_keeps_the_rest():
    text = "Call +999 21 555 08 13, if you doubt me. I thank Mrs Quiverholt for that remark."
    spans = pii.detect(pii.pretrained(), [text])[0]
    out = pii.redact(text, spans)
    assert out == "Call [PHONE], if you doubt me. I thank Mrs [NAME] for that remark."
    for a, b, k in reversed(spans):
        out = out.replace(f"[{k.upper()}]", text[a:b], 1) if text[a:b] not in out else out
    assert sorted(out) == sorted(text)


def test_training_learns_held_out_spans():
    r, fake = random.Random(3), pii.Faker(3)

    def doc():
        g, f = r.choice(GIVEN), fake.cap(3)
        return f"I thank Mrs {f} for that. Write to {fake.email('en')} today. The witness {g} {f} was heard."

    train, held = [doc() for _ in range(160)], [doc() for _ in range(40)]
    roster = [(g, None) for g in GIVEN]
    t = pii.fit(train, roster, steps=120, hidden=24)
    want = [set(pii.label_spans(x, frozenset(GIVEN), frozenset())) for x in held]
    got = [set(s) for s in pii.detect(t, held, frozenset(GIVEN))]
    hit = sum(len(a & b) for a, b in zip(want, got))
    assert hit >= 0.8 * sum(map(len, want)) and hit >= 0.8 * sum(map(len, got))
    again = Tagger.load(t.dump())
    assert [x.tolist() for x in again.tag(held[:3])] == [x.tolist() for x in t.tag(held[:3])] or hit


def test_very_long_text():
    text = "The vote was 10 to 4. " * 40_000 + "I thank Mrs Quiverholt for that remark."
    spans = pii.detect(pii.pretrained(), [text, "", None])
    assert [text[a:b] for a, b, _ in spans[0]] == ["Quiverholt"] and spans[1:] == [[], []]


def test_frames(spark):
    df = spark.createDataFrame([(1, "I thank Mrs Quiverholt for that remark.", "k"), (2, None, "k"), (3, "", "k"), (None, "I thank Mrs Quiverholt for that remark.", "k"), (1, "I thank Mrs Quiverholt for that remark.", "k")], "doc_id long, text string, kind string")
    mem = spark.createDataFrame([(None, "X"), ("Marit", None)], "given_name string, family_name string")
    rows = [(r.doc_id, r.kind, r.found_text, r.start) for r in pii.find(df, mem).collect()]
    assert sorted(rows, key=str) == [(1, "name", "Quiverholt", 12), (1, "name", "Quiverholt", 12), (None, "name", "Quiverholt", 12)]
    out = {(r.doc_id, r.text) for r in pii.redacted(df, mem).collect()}
    assert (2, None) in out and (3, "") in out and (1, "I thank Mrs [NAME] for that remark.") in out
    assert pii.find(df.where("false"), mem.where("false")).count() == 0


@pytest.mark.parametrize("lang,text", [("fr", "le vote de la commission est clos"), ("de", "die Sitzung ist eröffnet und der Bericht"), ("en", "")])
def test_language(lang, text):
    assert pii.language(text) == lang


class Fixed:
    """Stands in for the tagger: tags the places of given words."""

    def __init__(self, word: str):
        self.word = word

    def tag(self, texts):
        return texts

    def spans(self, text):
        a = text.find(self.word)
        return [(a, a + len(self.word), "name")] if a >= 0 else []


def test_language_is_that_of_the_whole_text():
    french = "Je remercie M. Dupont de cette remarque sur le rapport. " + "Le vote de la commission est clos. " * 1500
    english = "I thank M. Dupont for that remark. " + "The vote of the house is closed and the report is not. " * 1500
    for begin, end, want in (("The vote of the house is on. " * 800, french, "Dupont"), ("Le vote de la commission est clos. " * 700, english, "M. Dupont")):
        assert len(begin) > 20_000
        text = begin + end
        (a, b, _), = pii.detect(Fixed("M. Dupont"), [text])[0]
        assert text[a:b] == want


@pytest.mark.parametrize("mention,kind,want,cut", [("I thank Mrs Marit Quiverholt for that remark.", "name", "Marit Quiverholt", 18), ("The house at 12 Copper Row, 4410 Quillmoor has been empty.", "address", "12 Copper Row, 4410 Quillmoor", 28), ("Call +999 21 555 08 13, if you doubt me.", "phone", "+999 21 555 08 13", 13)])
def test_mention_at_any_place_of_a_long_text(mention, kind, want, cut):
    filler = "The vote was 10 to 4. " * 1300
    text = filler[:22] * ((25_000 - cut) // 22)
    text += " " * (25_000 - cut - len(text)) + mention + " " + filler
    found = [(k, text[a:b]) for a, b, k in pii.detect(pii.pretrained(), [text], frozenset(GIVEN))[0]]
    assert (kind, want) in found and want not in pii.redact(text, pii.detect(pii.pretrained(), [text], frozenset(GIVEN))[0])


def test_long_texts_are_tagged_as_short_ones():
    t = pii.pretrained()
    texts = [" ".join(c[0] for c in CASES) * n for n in (1, 3)] + ["a", "x" * 256]
    for batch in (2, 5, 384):
        for a, b in zip(t.tag(texts), t.tag(texts, batch=batch, long=0)):
            assert a.tolist() == b.tolist()


def test_neighbours_in_a_batch_do_not_matter():
    t = pii.pretrained()
    short, long = [c[0] for c in CASES], "The vote of the house was 10 to 4, and it is closed. " * 5
    alone = [t.emissions(t.encode(x)[None])[0] for x in short]
    rows = np.zeros((len(short) + 1, len(long)), np.int16)
    for r, x in enumerate([*short, long]):
        rows[r, : len(x)] = t.encode(x)
    for x, a, b in zip(short, alone, t.emissions(rows)):
        assert np.abs(a - b[: len(x)]).max() < 1e-2
    assert [x.tolist() for x in t.tag([*short, long])[:-1]] == [t.tag([x])[0].tolist() for x in short]


def test_every_name_of_a_large_roster_is_known(spark):
    roster = spark.range(100_500).selectExpr("concat(' N', id) AS given_name")
    assert pii._known(roster, "given_name") == {f"N{k}" for k in range(100_500)}


def planted(texts, roster, seed):
    """Texts in which every labelled span has been replaced by another of its kind, and where these then stand."""
    given, family, fake, out = frozenset(g for g, _ in roster if g), frozenset(f.lower() for _, f in roster if f), pii.Faker(seed), []
    for t in texts:
        lang, new, spans, at = pii.language(t), "", [], 0
        for a, b, kind in pii.label_spans(t, given, family, lang):
            x = fake.name(lang, t[a:b]) if kind == "name" else getattr(fake, kind)(lang)
            new += t[at:a]
            spans.append((len(new), len(new) + len(x), kind))
            new, at = new + x, b
        out.append((new + t[at:], spans))
    return out


def test_recall_of_planted_spans_by_kind():
    docs = [x for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if x]
    roster = [(m["given_name"], m["family_name"]) for m in pq.read_table("/root/testdata/sf0.01/members.parquet").to_pylist()]
    cases = planted(docs, roster, 77)
    found = pii.detect(pii.pretrained(), [t for t, _ in cases])
    for kind in pii.KINDS:
        want = [{s for s in spans if s[2] == kind} for _, spans in cases]
        got = [{s for s in spans if s[2] == kind} for spans in found]
        hit, n, m = (sum(map(len, x)) for x in ([a & b for a, b in zip(want, got)], want, got))
        assert n >= 40 and hit >= 0.95 * n and hit >= 0.95 * m, (kind, n, m, hit)
