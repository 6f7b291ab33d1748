"""Personal details in free text: found by a trained character tagger, checked by grammar, replaced by placeholders.

``fit`` trains the tagger (``tagger.Tagger``) on spans labelled in a bounded sample of documents (``SAMPLE_ROWS``) by
high-precision patterns and the roster of members; labelled spans are varied (other e-mail, telephone, number, address
and name forms in the same sentence) so that the tagger learns contexts and shapes rather than values. The weights in
``pii_weights.npz`` were trained so by ``train_pii``, and ``find`` uses them unless it is given another tagger. It tags
every document whole; a span proposed is then snapped to the form of its kind next to it, or dropped if there is none.

Defined results: null and empty texts hold nothing; texts of any length are tagged whole; repeated mentions give one
row each in ``find`` and one in the query; rows with a null id are kept with that id.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import plan_bytes
from .tagger import Tagger

KINDS = ["email", "phone", "id_number", "address", "name"]
#: Documents of the labelled sample, training steps, windows of a step and their length, hidden units: bounds of training.
SAMPLE_ROWS, STEPS, BATCH, WINDOW, HIDDEN = 8000, 2400, 64, 128, 48

# Titles that stand before a name and are no part of it, and particles within family names.
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mme|Mlle|Messrs|Frau|Herrn?|Madame|Monsieur|Sir|Lady|Lord|Dame)\b\.?"
PARTICLES = r"(?:van der|van den|van de|van|von der|von|zu|de la|del|della|di|du|de|der|den|la|le|ten|ter|VAN DER|VAN DEN|VAN|VON|DE LA|DE|DU)"
WORDS_FR = frozenset("le la les des du que est et une un au aux pour dans ne nous qui sur pas".split())
WORDS_DE = frozenset("der die das und ist den dem ein eine nicht wir von zu mit im des für".split())
WORDS_EN = frozenset("the of and to is that was for in it a has on be not with are".split())

UP = "A-ZÀ-ÖØ-ÞŁŚŠŽĆČ"
CAPWORD = rf"(?:[OD]['’])?[{UP}][\w'’]*[\w](?:-[\w'’]+)*"
FAMILY = rf"(?:{PARTICLES}\s+)?{CAPWORD}"
FIRST_FAMILY = rf"(?:(?:van der|van den|van de|van|VAN DER|de|DE)\s+)?{CAPWORD}"
TOWN = rf"[{UP}][\w'’]+(?:-[\w'’]+)*"
ZIP = r"(?:(?:[A-Z]{1,2}[- ])?\d{3,6}\s+)?"
EMAIL = re.compile(
    r"[\w.+%'-]*[\w+]\s?(?:@|[(\[{<](?:at|AT|a|arobase)[)\]}>])\s?[\w-]+(?:\s?(?:\.|[(\[{](?:dot|DOT|point|Punkt)[)\]}]|(?<=\s)(?:dot|DOT)(?=\s))\s?[A-Za-z][\w-]*)+"
    r"|[\w.+%-]*\w\s(?:at|AT)\s[\w-]+(?:\s(?:dot|DOT)\s[A-Za-z][\w-]*)+"
)
PHONE = re.compile(r"(?<![\w@])(?:\+|\()?\d[\d ().\-/–  ]{5,24}\d(?:,?\s?(?:ext|x|extension|poste|App|Durchwahl|DW|Nst)\.?\s?\d{1,5}(?!\w))?(?![\d])")
IDNUM = re.compile(r"(?<![\w])(?:[A-Z]{1,3}[ -]?)?\d[\d. /-]{3,20}\d(?:[ -]?[A-Z](?:[ -]?\d{1,4})?(?![\w]))?(?![\w])")
STREET_DE = rf"(?:(?:Alte[rsnm]?|Neue[rsnm]?|Ober[en]+|Unter[en]+|Große[rn]?|Kleine[rn]?|Lange[rn]?|Hohe[rn]?|Am|An der|Auf der|Auf dem|Zur|Zum|Im|Hinter der|Unter den)\s+){{0,2}}[{UP}][\w-]*(?:straße|strasse|str\.|weg|platz|ufer|gasse|allee|ring|damm|hof|markt|steig|pfad|wall|graben|kai|chaussee|berg|feld|brücke|promenade)\s\d+(?:\s?[A-Za-z](?!\w))?"
ADDRESS = re.compile(
    rf"(?:(?:P\.?\s?O\.?\s?Box|Post Office Box|Postfach|[Bb]o[iî]te postale|B\.?P\.?)\s*(?:n[o°]\s?)?\d+"
    rf"|(?:(?:Flat|Apartment|Apt\.?|Unit|Room|Suite|Appartement|appartement|Appt\.?|appt\.?|Wohnung)\s+\d+\w?,\s*)?(?:No\.?\s*)?\d+\s?(?:bis|ter|quater|[A-Za-z](?!\w))?,?\s+(?:(?:[{UP}][\w'’-]+\s?){{1,4}}|(?:rue|avenue|place|chemin|boulevard|allée|impasse|quai|route|cours|square|sentier|ruelle|passage)\s[^,\n\d]{{2,50}})"
    rf"|{STREET_DE}),\s+{ZIP}{TOWN}"
)
NAME = re.compile(rf"(?:{FAMILY},\s+{CAPWORD}(?:\s+[{UP}]\.)?|(?:(?:{CAPWORD}|[{UP}]\.)\s+(?:[{UP}]\.\s+)*)?{FAMILY}(?:\s{CAPWORD})?)")
FORMS = {"email": EMAIL, "phone": PHONE, "id_number": IDNUM, "address": ADDRESS}


def language(text: str) -> str:
    c = Counter(re.findall(r"[^\W\d_]+", text.lower()))
    n = {k: sum(c[w] for w in ws) for k, ws in (("en", WORDS_EN), ("fr", WORDS_FR), ("de", WORDS_DE))}
    return max(n, key=lambda k: (n[k], k == "en"))


# Labels for training ------------------------------------------------------------------------------------------------

ID_CONTEXT = re.compile(r"(?:number|no\.|nummer|numéro|n°|passport|Reisepass|passeport|Ausweis|insurance|identity|identité|personnel)[,:]?\s*(?:est le\s*)?$", re.I)
NOT_ID = re.compile(r"(?:line|Titel|ligne|report|document|Drucksache|petition|Petition|pétition|rule|vote was|PE|Pages?|B-)\s*$")
STRICT_ID = re.compile(r"(?<![\w+])(?:[A-Z]{2} ?\d{3} ?\d{4}|\d{6}-\d{4}[A-Z]|\d{11}|\d{3} \d{3} \d{3} \d{2})(?![\w])")
STRICT_PHONE = re.compile(r"(?<![\w+])(?:(?:\+|00)\d[\d ()/.-]{7,18}\d|\(0\d{1,4}\)[\d ./-]{5,14}\d|0\d{1,4}[ ./-][\d ./-]{5,14}\d)(?:\s(?:ext|poste|App|Durchwahl)\.?\s?\d{1,5})?(?![\w])")


def label_spans(text: str, given: frozenset[str], family: frozenset[str], lang: str | None = None) -> list[tuple[int, int, str]]:
    """Spans that can be told with high precision, for training only."""
    lang = lang or language(text)
    taken = np.zeros(len(text) + 1, bool)
    out = []

    def put(a: int, b: int, kind: str) -> None:
        if a < b and not taken[a:b].any():
            taken[a:b] = True
            out.append((a, b, kind))

    for m in EMAIL.finditer(text):
        if "@" in m[0] or re.search(r"[\[({<](?:at|AT)", m[0]):
            put(m.start(), m.end(), "email")
    for m in ADDRESS.finditer(text):
        if re.search("[a-zß-ÿ]{2}", m[0]):
            put(m.start(), m.end(), "address")
    for m in STRICT_ID.finditer(text):
        if not NOT_ID.search(text[max(0, m.start() - 24) : m.start()]):
            put(m.start(), m.end(), "id_number")
    for m in STRICT_PHONE.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 9 and not NOT_ID.search(text[max(0, m.start() - 24) : m.start()]):
            put(m.start(), m.end(), "phone")
    title = rf"(?:{TITLES}{'|M[.]' if lang == 'fr' else ''})"
    core = rf"(?:{CAPWORD}\s+)?(?:[{UP}]\.\s+)*{FAMILY}"
    for m in re.finditer(rf"(?<!\w){title}\s+({core})", text):
        a, b = m.span(1)
        words = m[1].split()
        if len(words) > 1 and words[0] not in given and not re.match(rf"{PARTICLES}\s|[{UP}]\.", m[1]):
            b = a + len(words[0])  # a family name followed by another word in capitals
        put(a, b, "name")
    if given:
        known = "|".join(sorted(map(re.escape, given), key=len, reverse=True))
        follows = rf"\s+(?:[{UP}]\.\s+)*{FAMILY}"
        for m in re.finditer(rf"(?<![\w-])({FIRST_FAMILY}),\s+(?:{known})(?![\w-])(?!{follows})", text):
            put(m.start() + preposition(text, m.start(), lang, family), m.end(), "name")
        for m in re.finditer(rf"(?<![\w-])(?:{known}){follows}", text):
            put(m.start(), m.end(), "name")
    initial = f"[{UP.replace('M', '') if lang == 'fr' else UP}]"
    for m in re.finditer(rf"(?<![\w.])[{UP}]\.\s+(?:[{UP}]\.\s+)*{FAMILY}", text):
        before = text[max(0, m.start() - 2) : m.start()]
        if not (lang == "fr" and m[0].startswith("M.")) and re.match(initial, m[0]) and not re.search(r"[A-Z]\.?\s$", before):
            put(m.start(), m.end(), "name")
    for m in re.finditer(rf"(?<![\w-]){FIRST_FAMILY}", text):
        for a in (m.start(), m.start() + len(re.match(r"(?:(?:van der|van den|van de|van|de)\s+)?", m[0], re.I)[0])):
            if text[a : m.end()].lower() in family:
                put(a, m.end(), "name")
                break
    return sorted(out)


def preposition(text: str, a: int, lang: str, family: frozenset[str]) -> int:
    """Characters to skip where a French ``de`` at ``a`` belongs to the word before it rather than to the name."""
    if lang != "fr" or text[a : a + 3].lower() != "de ":
        return 0
    if re.match(r"de [\w'’-]+", text[a:], re.I)[0].lower() in family:
        return 0
    return 0 if re.search(r"(?:^|[.,:;(\[–\n]|\b(?:par|à|avec|chez))\s*$", text[max(0, a - 8) : a]) else 3


class Faker:
    """Other spans of a kind, for variation in training."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, n: int) -> str:
        r = self.r
        return "".join(r.choice(["b", "br", "c", "ch", "d", "dr", "f", "fl", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "r", "s", "st", "sk", "t", "tr", "v", "w", "z", "th"]) + r.choice(["a", "e", "i", "o", "u", "a", "e", "i", "o", "ie", "ei", "é", "ö", "ü", "ø"]) + r.choice(["", "", "n", "r", "l", "s", "nd", "rt", "ll", "ck", "ss", "m"]) for _ in range(n))

    def cap(self, n: int | None = None) -> str:
        w = self.word(n or self.r.choice([1, 2, 2, 3]))
        return w[0].upper() + w[1:]

    def email(self, lang: str) -> str:
        r = self.r
        ascii_ = lambda n: re.sub(r"[^a-z]", "e", self.word(n))
        a, b = ascii_(2), ascii_(r.choice([2, 3]))
        local = r.choice([f"{a}.{b}", f"{a[0]}{b}", f"{b}_{r.randint(1, 99)}", f"{a}-{b}", f"{a}+{ascii_(1)}{r.randint(1, 9)}", f"{a}{r.randint(1, 2000)}", f"{a}.{b[0]}.{b}"])
        at, dot = r.choice([("@", ".")] * 6 + [(" @ ", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "."), (" [at] ", "."), (" (at) ", " (dot) ")])
        parts = [ascii_(2) for _ in range(r.choice([1, 1, 2]))] + [r.choice(["example", "test", "invalid", "org", "com", "net", "eu", "fr", "de", "info", "example.org"])]
        out = local + at + dot.join(parts).replace(".", dot if dot == "." else ".")
        return out.upper() if r.random() < 0.1 else out

    def digits(self, form: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "#" else c for c in form)

    def phone(self, lang: str) -> str:
        r = self.r
        s = r.choice([" ", "-", ".", "/", " ", ""])
        head = r.choice(["+###", "00###", "+##", "0##", "(0##)", "+###(0)##", "0###", "+## (0)##", "(0###)"])
        if s == "" and head[0] in "0(":
            s = r.choice([" ", "-"])
        tail = r.choice([f"###{s}####", f"###{s}##{s}##", "#######", "### ## ##", f"##{s}##{s}##{s}##", f"######", f"##{s}###{s}##{s}##", f"####{s}####"])
        out = head + s + (f"##{s}" if head in ("+###", "00###", "+##") else "") + tail
        return self.digits(out) + (r.choice([" ext. ##", " ext ##", " ext. ###", " poste ##", " Durchwahl ##"]).replace("#", str(r.randint(1, 9))) if r.random() < 0.15 else "")

    def id_number(self, lang: str) -> str:
        r = self.r
        two = "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(2))
        last = r.choice("ABCDEFGHJKLMNPRSTUVWXYZ")
        return self.digits(r.choice([f"{two}#######", f"{two} ### ####", f"######-####{last}", "###########", "### ### ### ##", f"{two}######", f"######-####", f"{two} ## ## ## {last}", f"{last}########", "### ## ####", "##.##.##-###.##", "# ## ## ## ### ### ##", "###-##-####", f"## ###### {last} ###", f"{two}########", "###########"]))

    def address(self, lang: str) -> str:
        r = self.r
        town = (r.choice(["", "", f"{r.randint(1000, 9999)} ", f"{r.randint(10000, 99999)} "])) + self.cap(r.choice([2, 3]))
        n = r.randint(1, 260)
        if lang == "fr":
            street = f"{n}{r.choice(['', '', ' bis', ' ter'])}, {r.choice(['rue', 'avenue', 'place', 'chemin', 'boulevard', 'allée', 'impasse', 'quai'])} {r.choice(['de la ', 'du ', 'des ', ''])}{self.cap()}{r.choice(['', '-' + self.cap()])}"
            return f"{street}, {town}"
        if lang == "de":
            street = f"{r.choice(['', '', 'Alte ', 'Neue ', 'Am '])}{self.cap()}{r.choice(['straße', 'weg', 'platz', 'ufer', 'gasse', 'allee', 'ring', 'damm'])} {n}{r.choice(['', '', ' B', 'a', ' c'])}"
            return f"{street}, {town}"
        if r.random() < 0.2:
            return f"{r.choice(['P.O. Box', 'PO Box', 'P. O. Box'])} {n}, {town}"
        street = f"{self.cap()}{r.choice(['', ' ' + self.cap()])} {r.choice(['Road', 'Street', 'Lane', 'Avenue', 'Close', 'Row', 'Bank', 'Hill', 'Terrace', 'Way', 'Drive'])}"
        return f"{r.choice(['', '', 'Flat #, ', 'Apartment ##, ', 'No. ']).replace('#', str(r.randint(1, 9)))}{n}{r.choice(['', '', 'A', 'b'])} {street}, {town}"

    def name(self, lang: str, like: str) -> str:
        """A name in the form of ``like``."""
        r = self.r

        def sub(w: str) -> str:
            if re.fullmatch(rf"[{UP}]\.", w):
                return r.choice("ABCDEFGHIJKLNOPRSTUVWYZ") + "."
            if not re.match(rf"[{UP}]", w) or re.fullmatch(PARTICLES, w):
                return w
            tail = "," if w.endswith(",") else ""
            parts = [self.cap(r.choice([2, 2, 3])) for _ in w.split("-")] if r.random() < 0.7 else [self.cap(r.choice([2, 3]))]
            out = ("O'" if w.startswith("O'") else "") + "-".join(parts)
            return (out.upper() if len(w) > 3 and w.isupper() else out) + tail

        return re.sub(r"\S+", lambda m: sub(m[0]), like)


def training_windows(texts: list[str], given: frozenset[str], family: frozenset[str], tagger: Tagger, seed: int = 11, want: int = STEPS * BATCH):
    """(symbols, tags) rows of ``WINDOW`` characters around labelled spans, with variation, and without any."""
    fake, r = Faker(seed), random.Random(seed)
    tag_of = {k: 1 + 2 * i for i, k in enumerate(tagger.kinds)}
    rare, named, plain = [], [], []
    for t in texts:
        lang = language(t)
        spans = label_spans(t, given, family, lang)
        step = WINDOW - 24
        for a in range(r.randint(-40, 0), max(1, len(t) - 24), step):
            a = max(0, a)
            mine = [s for s in spans if s[1] > a - 30 and s[0] < a + WINDOW + 30]
            inside = [s for s in mine if s[0] < a + WINDOW and s[1] > a]
            (rare if any(s[2] != "name" for s in inside) else named if inside else plain).append((t, a, mine, lang))

    def window(t: str, a: int, mine: list, lang: str, vary: float):
        lo, hi = min([a] + [s[0] for s in mine]), max([a + WINDOW] + [s[1] for s in mine])
        lo, out, tags, at = max(0, lo), [], [], max(0, lo)
        shift = 0
        for s, e, kind in mine:
            out.append(t[at:s])
            tags += [0] * (s - at)
            x = t[s:e]
            if r.random() < vary:
                y = fake.name(lang, x) if kind == "name" else getattr(fake, kind)(lang)
                if s < a:
                    shift += len(y) - len(x)
                x = y
            out.append(x)
            tags += [tag_of[kind]] + [tag_of[kind] + 1] * (len(x) - 1)
            at = e
        out.append(t[at:hi])
        tags += [0] * max(0, min(hi, len(t)) - at)
        text = "".join(out)
        b = max(0, a - lo + shift)
        return text[b : b + WINDOW], tags[b : b + WINDOW]

    rows = []
    shares = [(rare, 0.36), (named, 0.4), (plain, 0.24)]
    for pool, share in shares:
        if not pool:
            continue
        order: list = []
        while len(order) < int(want * share):
            part = pool[:]
            r.shuffle(part)
            order += part
        for k, w in enumerate(order[: int(want * share)]):
            rows.append(window(*w, vary=0.35 if k < len(pool) else 0.7))
    r.shuffle(rows)
    sym = np.zeros((len(rows), WINDOW), np.int16)
    tags = np.zeros((len(rows), WINDOW), np.int64)
    valid = np.zeros((len(rows), WINDOW), bool)
    for k, (text, tg) in enumerate(rows):
        n = min(len(text), len(tg))
        sym[k, :n] = tagger.encode(text[:n])
        tags[k, :n] = tg[:n]
        valid[k, :n] = True
    ok = valid[:, 0]
    return sym[ok], tags[ok], valid[ok]


def fit(texts: list[str], members: list[tuple[str | None, str | None]], steps: int = STEPS, hidden: int = HIDDEN, log=None) -> Tagger:
    """A tagger trained on the labelled sample."""
    texts = sorted(t for t in texts if t)
    given = frozenset(g for g, _ in members if g)
    family = frozenset(f.lower() for _, f in members if f)
    chars = "".join(sorted(c for c, n in Counter("".join(texts)).items() if n >= 20 and not c.isdigit()))
    tagger = Tagger(KINDS, chars, hidden)
    if texts:
        sym, tags, valid = training_windows(texts, given, family, tagger, want=steps * BATCH)
        batches = [(sym[k : k + BATCH], tags[k : k + BATCH], valid[k : k + BATCH]) for k in range(0, len(sym), BATCH)]
        losses = tagger.train(batches)
        if log:
            log(losses)
    return tagger


# Check of what the tagger proposes ----------------------------------------------------------------------------------

LEFT_TITLE = re.compile(rf"^(?:{TITLES}\s+)+")
LEFT_INITIALS = re.compile(rf"(?<![\w.'’-])((?:[{UP}]\.\s+)+)$")
LEFT_VAN = re.compile(r"(?<!\w)((?:van|VAN)\s+)$")
SHOUTED = re.compile(rf"[{UP}]{{2,}}['’,.:]?\s*(?:[{UP}]\s+)?$")
SHOUTED_ON = re.compile(rf"[,.:]?\s+(?:\d+\s+)?[{UP}]{{2,}}(?![a-zß-ÿ])")
LAST_WORD = re.compile(r"(?<![\w'’-])([^\W\d_][\w'’-]*)\s+$")
LEFT_PARTICLE = re.compile(r"(?<!\w)((?:van der|van den|van de|von der|VAN DER|VON DER)\s+)$")


def snap(text: str, a: int, b: int, kind: str, lang: str, given: frozenset[str] = frozenset(), places: frozenset[str] = frozenset()) -> tuple[int, int] | None:
    """The form of ``kind`` that the proposed span stands for, or None."""
    if kind != "name":
        lo = max(0, a - 60)
        best = None
        for m in FORMS[kind].finditer(text, lo, min(len(text), b + 60)):
            over = min(b, m.end()) - max(a, m.start())
            if over > 0 and (best is None or over > best[0]):
                best = (over, m.start(), m.end())
        if best is None or best[0] * 2 < b - a:
            return None
        s, e = best[1:]
        if kind == "address" and s < a and re.fullmatch(r"(?:[^\W\d_]+\s+)+", text[s:a]) and not text[a - 1].isalnum() and ADDRESS.match(text, a):
            s = a  # words in capitals before the street
        digits = sum(c.isdigit() for c in text[s:e])
        if kind == "phone" and digits < 7 or kind == "id_number" and digits < 5:
            return None
        return s, e
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "'’-" and a > 1 and text[a - 2].isalnum()) and text[a].isalnum():
        a -= 1
    while b < len(text) and (text[b].isalnum() and (text[b - 1].isalnum() or text[b - 1] in "'’-") or text[b] in "'’-" and b + 1 < len(text) and text[b + 1].isalnum() and text[b - 1].isalnum()):
        b += 1
    while True:
        m = LEFT_TITLE.match(text[a:b])
        if m is None and lang == "fr":
            m = re.match(r"M\.\s+", text[a:b])
        if m is None:
            break
        a += m.end()
    while a < b and not text[a].isalpha():
        a += 1
    while a < b and not (text[b - 1].isalnum() or text[b - 1] == "." and re.search(rf"(?:^|\s)[{UP}]\.$", text[a:b]) and "," in text[a:b]):
        b -= 1
    if text[a:b].endswith(("'s", "’s")):
        b -= 2
    m = LEFT_PARTICLE.search(text[max(0, a - 12) : a]) or (re.match(r"(?:der|den|de)\s", text[a:b], re.I) and LEFT_VAN.search(text[max(0, a - 8) : a]))
    if m:
        a -= len(m[1])
    m = LEFT_INITIALS.search(text[max(0, a - 16) : a])
    if m and not (lang == "fr" and m[1].startswith("M.")):
        a -= len(m[1])
    m = LAST_WORD.search(text[max(0, a - 24) : a])
    if m and m[1] in given:
        a -= len(m[0])  # the given name before it
    if text[a:b] in given:
        m = re.compile(rf",?\s+(?:[{UP}]\.\s+)*{FAMILY}").match(text, b)
        b = m.end() if m and not m[0].startswith(",") else b
    elif m := re.compile(rf",\s+({CAPWORD})").match(text, b):
        b = m.end() if m[1] in given and text[a:b].split()[0] not in given else b
    head, comma, tail = text[a:b].partition(",")
    if comma and len(tail.split()) > 1:
        a += len(head) + 1 + len(tail) - len(tail.lstrip())  # what stands before a whole name and a comma is no part of it
    words = [(m.start() + a, m[0]) for m in re.finditer(r"[^\s,]+", text[a:b])]
    at = next((k for k, (_, w) in enumerate(words) if w in given), 0)
    if at and "," not in text[a:b] and not all(w.endswith(".") for _, w in words[:at]):
        a = words[at][0]  # words in capitals before a given name
    if a >= b or not re.search(rf"[{UP}]\w", text[a:b]):
        return None
    if text[a:b].isupper() and not any(w in given for _, w in words) and (SHOUTED.search(text[max(0, a - 24) : a]) or SHOUTED_ON.match(text[b : b + 24])):
        return None  # a passage in capitals
    if text[a:b] in places and not re.search(rf"{TITLES}\s+$", text[max(0, a - 12) : a]):
        return None
    if b - a < 3 or sum(c.isalpha() for c in text[a:b]) < 3:
        return None
    return a, b


def _sentences(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """The spans; a name that runs over the end of a sentence is two."""
    for a, b, kind in spans:
        at = a
        if kind == "name":
            for m in re.finditer(r"(?<=\w\w)[.!?]\s+", text[a:b]):
                yield at, a + m.start(), kind
                at = a + m.end()
        yield at, b, kind


def detect(tagger: Tagger, texts: list[str | None], given: frozenset[str] = frozenset(), places: frozenset[str] = frozenset()) -> list[list[tuple[int, int, str]]]:
    """Checked spans of each text, in order and without overlap."""
    out: list[list] = [[] for _ in texts]
    for k, (t, tags) in enumerate(zip(texts, tagger.tag([t or "" for t in texts]))):
        found = tagger.spans(tags)
        if not found:
            continue
        lang = language(t) if any(x[2] == "name" for x in found) else "en"
        end = 0
        for a, b, kind in _sentences(t, found):
            x = snap(t, a, b, kind, lang, given, places)
            if x and x[0] >= end:
                out[k].append((*x, kind))
                end = x[1]
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def sample(docs: DataFrame, doc_id: str, text: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """Texts of at most ``rows`` documents, the first by a hash of the id."""
    ids = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(doc_id).orderBy(F.xxhash64(doc_id), doc_id).limit(rows)
    return [r[0] for r in docs.join(F.broadcast(ids), doc_id, "left_semi").select(text).limit(rows).toLocalIterator() if r[0]]


def _known(members: DataFrame, col: str) -> frozenset[str]:
    """Distinct values of a column of the roster, for the check of names: all of them; Spark refuses to collect more than ``spark.driver.maxResultSize``."""
    if col not in members.columns:
        return frozenset()
    c = F.trim(F.col(col))
    return frozenset(r[0] for r in members.select(c).where(c != "").distinct().collect())


def pretrained() -> Tagger:
    return Tagger.load(files(__package__).joinpath("pii_weights.npz").read_bytes())


def _tasks(df: DataFrame) -> int:
    """Tasks for a costly step: four a core, but none of more than 16 MB (up to 100 TB in a million tasks) or less than 64 KB of input."""
    size, usual = plan_bytes(df), 4 * df.sparkSession.sparkContext.defaultParallelism
    if size > 1 << 60:  # not known
        return usual
    return max(1, min(-(-size // (64 << 10)), max(usual, size // (16 << 20)), 1_000_000))


def _by_group(docs: DataFrame, members: DataFrame, doc_id: str, text: str, tagger: Tagger | None, make, schema: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast((tagger or pretrained(), _known(members, "given_name"), _known(members, "constituency")))
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    src = src.repartition(_tasks(src))  # in turn, whatever ids and texts are; tagging costs far more than moving the texts, and file splits would be too few or too long

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag, given, places = model.value
        for f in frames:
            for k in range(0, len(f), 2000):
                d = f["d"].iloc[k : k + 2000].tolist()
                t = [x if isinstance(x, str) else None for x in f["t"].iloc[k : k + 2000]]
                each = list(dict.fromkeys(t))  # copies of a text are tagged once
                found = dict(zip(each, detect(tag, each, given, places)))
                yield make(d, t, [found[x] for x in t])

    return src.mapInPandas(run, f"`{doc_id}` {src.schema['d'].dataType.simpleString()}, {schema}")


def find(docs: DataFrame, members: DataFrame, doc_id: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, kind, start, end, found_text) of every mention."""

    def make(d, t, found):
        out = [(i, kind, a, b, x[a:b]) for i, x, spans in zip(d, t, found) for a, b, kind in spans]
        return pd.DataFrame(out, columns=[doc_id, "kind", "start", "end", "found_text"])

    return _by_group(docs, members, doc_id, text, tagger, make, "kind string, start int, end int, found_text string")


def redacted(docs: DataFrame, members: DataFrame, doc_id: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, text, n_replaced) with typed placeholders; null texts stay null."""

    def make(d, t, found):
        return pd.DataFrame({doc_id: d, text: [x and redact(x, s) for x, s in zip(t, found)], "n_replaced": [len(s) for s in found]})

    return _by_group(docs, members, doc_id, text, tagger, make, f"`{text}` string, n_replaced int")
