"""Basic graph patterns: a small AST, its text as a query, its plan over a triples table, and the template generator.

A pattern compiles to one scan per triple pattern with its constants as filters; shared variables are equi-join keys;
FILTER terms are predicates on the joined columns. Catalyst orders and places them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NAMESPACES
from ..operators.graph import Stored
from ..session import cut, together
from ..sources.tables import small


def is_var(term: str) -> bool:
    return term.startswith("?")


@dataclass(frozen=True)
class Bgp:
    patterns: tuple[tuple[str, str, str], ...]
    #: (term, term) that must differ.
    differ: tuple[tuple[str, str], ...] = ()
    #: variables that must be entities (codes), not literals
    entities: tuple[str, ...] = ()
    name: str = ""
    distance: int = 0
    limit: int | None = None
    #: variables of the result, none: all; ``counted``: only the number of matches; ``distinct``: each row once
    select: tuple[str, ...] = ()
    counted: bool = False
    distinct: bool = False
    #: of a template: its ends, the edges from each to where they meet, and whether the arrows run on, meet or part there
    shape: tuple[str, str, int, int, str] | None = None

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(t for p in self.patterns for t in p if is_var(t)))

    @property
    def predicates(self) -> list[str]:
        return list(dict.fromkeys(p for _, p, _ in self.patterns if is_var(p)))

    @property
    def objects(self) -> list[str]:
        return [v for v in self.variables if v not in self.predicates]

    # building -------------------------------------------------------------------------------------------------------

    @staticmethod
    def direct(o1: str, o2: str, d: int) -> "Bgp":
        """o1 -> ... -> o2 in ``d`` edges."""
        terms = [o1, *[f"?of{i}" for i in range(1, d)], o2]
        return Bgp(tuple((terms[i], f"?pf{i + 1}", terms[i + 1]) for i in range(d)), name=f"direct_{d}", distance=d, shape=(o1, o2, -(-d // 2), d // 2, "on"))

    @staticmethod
    def via_middle(first: str, second: str, a: int, b: int, inward: bool) -> "Bgp":
        """first and second joined at ``?middle``, ``a`` and ``b`` edges away; arrows towards it, or all reversed."""

        def chain(end: str, tag: str, n: int) -> list:
            terms = [end, *[f"?o{tag}{i}" for i in range(1, n)], "?middle"]
            steps = [(terms[i], f"?p{tag}{i + 1}", terms[i + 1]) for i in range(n)]
            return steps if inward else [(o, p, s) for s, p, o in steps]

        return Bgp(tuple(chain(first, "f", a) + chain(second, "s", b)), name=f"middle_{a}_{b}_{'in' if inward else 'out'}", distance=a + b, shape=(first, second, a, b, "meet" if inward else "part"))

    def filtered(self, ignored_objects=(), ignored_properties=(), cycles: int = 0, ends: tuple[str, str] | None = None) -> "Bgp":
        """FILTER terms: objects are no literals; ignored terms are excluded; cycles 1: no endpoint inside; 2: no object twice, too."""
        differ = [(p, x) for p in self.predicates for x in ignored_properties]
        for v in self.objects:
            differ += [(v, x) for x in ignored_objects]
            if cycles and ends:
                differ += [(v, x) for x in ends]
            if cycles > 1:
                differ += [(v, w) for w in self.objects if w != v]
        return replace(self, differ=tuple(differ), entities=tuple(self.objects))

    # text -----------------------------------------------------------------------------------------------------------

    @staticmethod
    def term(t: str) -> str:
        if is_var(t):
            return t
        for p, uri in NAMESPACES.items():
            if t.startswith(uri):
                return f"{p}:{t[len(uri) :]}"
            if t.startswith(p + ":"):
                return t
        return f"<{t}>"

    def text(self, count: bool = False) -> str:
        body = " . ".join(" ".join(map(self.term, p)) for p in self.patterns)
        terms = [f"!isLiteral({v})" for v in self.entities] + [f"{self.term(a)} != {self.term(b)}" for a, b in self.differ]
        where = f"{body} FILTER {conjunction(terms)}" if terms else body
        head = "".join(f"PREFIX {p}: <{u}>\n" for p, u in NAMESPACES.items())
        return f"{head}SELECT {'count(*)' if count else '*'} WHERE {{ {where} }}" + (f" LIMIT {self.limit}" if self.limit else "")

    @staticmethod
    def parse(query: str) -> "Bgp":
        """The language that ``text`` writes: PREFIX, SELECT (``*``, ``count(*)`` or variables, DISTINCT or not), triple
        patterns, one FILTER of ``!isLiteral(?x)`` and ``a != b`` joined by ``&&``, LIMIT. Anything else is an error."""
        return _Parser(query).query()


class _Parser:
    """Recursive descent over the tokens of a query."""

    TOKEN = re.compile(
        r"""\s*(?:(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<name>[A-Za-z_][\w-]*:(?:[\w/#%@-]|\.(?=[\w/#%@-]))*)|(?P<op>&&|!=|[!{}().*])|(?P<word>[A-Za-z]\w*)|(?P<int>\d+))"""
    )

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(text.rstrip())
        while at < end:
            m = self.TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"not understood: {text[at : at + 30].strip()!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.names = 0, {}

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str:
        """The next token, which must be one of ``wanted`` (kinds of terms, or words and signs as they are written)."""
        kind, x = self.peek()
        if kind not in wanted and x not in wanted and x.upper() not in wanted:
            raise ValueError(f"{' or '.join(wanted)} expected, found {x or 'the end'!r}")
        self.at += 1
        return x

    def has(self, *words: str) -> bool:
        ok = self.peek()[1].upper() in words
        self.at += ok
        return ok

    def term(self) -> str:
        kind, x = self.peek()
        if kind == "word":
            raise ValueError(f"a term expected, found {x!r}")
        self.take("iri", "var", "name")
        if kind == "iri":
            return x[1:-1]
        if kind == "var":
            return "?" + x[1:]
        prefix, _, rest = x.partition(":")
        if prefix not in self.names:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.names[prefix] + rest

    def query(self) -> Bgp:
        while self.has("PREFIX"):
            name = self.take("name")
            if not name.endswith(":"):
                raise ValueError(f"a prefix ends in a colon: {name!r}")
            self.names[name[:-1]] = self.take("iri")[1:-1]
        self.take("SELECT")
        distinct, counted, select = self.has("DISTINCT"), self.has("COUNT"), []
        if counted:
            for x in "(*)":
                self.take(x)
        elif not self.has("*"):
            select.append(self.term_var())
            while self.peek()[0] == "var":
                select.append(self.term_var())
        self.has("WHERE")
        self.take("{")
        pats = []
        while self.peek()[1] != "}" and self.peek()[1].upper() != "FILTER":
            pats.append((self.term(), self.term(), self.term()))
            if not self.has(".") and self.peek()[1] != "}" and self.peek()[1].upper() != "FILTER":
                raise ValueError("a triple pattern has three terms")
        if not pats:
            raise ValueError("no triple patterns")
        differ, entities = [], []
        if self.has("FILTER"):
            self.condition(differ, entities)
            self.has(".")
        self.take("}")
        limit = int(self.take("int")) if self.has("LIMIT") else None
        if self.peek()[0] != "end":
            raise ValueError(f"not understood: {self.peek()[1]!r}")
        known = {t for p in pats for t in p}
        for v in [*select, *entities, *[t for d in differ for t in d if is_var(t)]]:
            if v not in known:
                raise ValueError(f"{v} is in no triple pattern")
        return Bgp(tuple(pats), tuple(differ), tuple(entities), limit=limit, select=tuple(select), counted=counted, distinct=distinct)

    def term_var(self) -> str:
        return "?" + self.take("var")[1:]

    def condition(self, differ: list, entities: list) -> None:
        """``(c && c ...)``, where c is such a condition again, ``!isLiteral(?x)`` or ``a != b``."""
        self.take("(")
        while True:
            if self.peek()[1] == "(":
                self.condition(differ, entities)
            elif self.has("!"):
                self.take("ISLITERAL")
                self.take("(")
                entities.append(self.term_var())
                self.take(")")
            else:
                a = self.term()
                self.take("!=")
                differ.append((a, self.term()))
            if not self.has("&&"):
                break
        self.take(")")


def answer(query: str, triples: DataFrame, literals: DataFrame | None = None) -> DataFrame:
    """The result of a query given as text, over distinct ``triples``."""
    b = Bgp.parse(query)
    if b.counted:
        return count(b, triples, literals)
    if not b.select:
        return evaluate(b, triples, literals)
    if b.distinct:
        return evaluate(b, triples, literals, keep=list(b.select))
    out = evaluate(Bgp(b.patterns, b.differ, b.entities), triples, literals).select(*[v[1:] for v in b.select])
    return out.orderBy(*out.columns).limit(b.limit) if b.limit else out


def conjunction(terms: list[str], op: str = "&&") -> str:
    """``((a) && (b))``."""
    return "(" + f" {op} ".join(f"({t})" for t in terms) + ")"


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))


def _connected(patterns) -> list[tuple[str, str, str]]:
    """The patterns in an order in which each shares a variable with those before it, as far as that is possible."""
    rest, out, bound = list(patterns), [], set()
    while rest:
        p = next((p for p in rest if bound & set(filter(is_var, p))), rest[0])
        rest.remove(p)
        out.append(p)
        bound |= set(filter(is_var, p))
    return out


def evaluate(bgp: Bgp, triples: DataFrame | Stored, literals: DataFrame | None = None, keep: list[str] | None = None, repeats: bool = False) -> DataFrame:
    """A row per match, a column per variable (without ``?``), in order of appearance.

    ``literals``: triples whose object is a literal. ``keep``: only these variables, as distinct rows; a variable is then
    dropped, and repetitions with it, as soon as no later pattern needs it, so its bindings are never multiplied.
    ``repeats``: the triples may be repeated; the result is made distinct instead of the (much larger) table. Of a stored
    graph a pattern with a constant object reads the triples sorted by object, any other those sorted by subject.
    """

    def every(pattern: tuple[str, str, str]) -> DataFrame:
        t = triples
        if isinstance(t, Stored):
            t = t.by_object if is_var(pattern[0]) and not is_var(pattern[2]) else t.by_subject
        return t if literals is None else t.unionByName(literals.select("s", "p", "o"))

    order = _connected(bgp.patterns)
    wanted = set(keep if keep is not None else bgp.variables) | {t for d in bgp.differ if all(map(is_var, d)) for t in d}
    out: DataFrame | None = None
    for k, pattern in enumerate(order):
        scan, here = every(pattern), {}
        later = wanted | {t for p in order[k + 1 :] for t in p}
        for pos, t in zip("spo", pattern):
            if not is_var(t):
                scan = scan.where(F.col(pos) == t)
            elif t in here:
                scan = scan.where(F.col(pos) == F.col(here[t]))
            else:
                here[t] = pos
        if literals is not None and pattern[2] in bgp.entities:
            scan = scan.join(literals.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
        scan = scan.select(*[F.col(pos).alias(t[1:]) for t, pos in here.items()])
        for a, b in bgp.differ:  # terms of this scan alone, so that they reach it
            if a in here and not is_var(b):
                scan = scan.where(F.col(a[1:]) != b)
        bound = set() if out is None else {"?" + c for c in out.columns}
        if keep is not None and set(here) - later - bound:
            scan = scan.select(*[t[1:] for t in here if t in later | bound]).distinct()
        if out is None:
            out = scan
            continue
        shared = [c for c in out.columns if c in scan.columns]
        if not shared:
            raise ValueError("the pattern falls into parts that share no variable")
        out = out.join(scan, shared)
        if keep is not None and {"?" + c for c in out.columns} - later:
            out = out.select(*[c for c in out.columns if "?" + c in later]).distinct()
    assert out is not None
    both = [F.col(a[1:]) != F.col(b[1:]) for a, b in bgp.differ if is_var(a) and is_var(b)]
    out = out.where(all_of(both)).select(*[v[1:] for v in (bgp.variables if keep is None else keep)])
    if keep is not None or repeats:
        out = out.distinct()
    return out.orderBy(*out.columns).limit(bgp.limit) if bgp.limit else out


def count(bgp: Bgp, triples: DataFrame, literals: DataFrame | None = None) -> DataFrame:
    """One row: n, 0 if there is no match."""
    return evaluate(Bgp(bgp.patterns, bgp.differ, bgp.entities), triples, literals).agg(F.count(F.lit(1)).alias("n"))


def templates(o1: str, o2: str, longest: int, limit: int | None = None, ignored_objects=(), ignored_properties=(), cycles: int = 0) -> list[Bgp]:
    """All ways in which o1 and o2 may be related in up to ``longest`` edges: 2 d of them at distance d."""
    out = []
    for d in range(1, longest + 1):
        found = [Bgp.direct(o1, o2, d), Bgp.direct(o2, o1, d)]
        found[1] = replace(found[1], name=f"direct_{d}_back")
        for a in range(1, d):
            found += [Bgp.via_middle(o1, o2, a, d - a, inward) for inward in (True, False)]
        out += [x.filtered(ignored_objects, ignored_properties, cycles, (o1, o2)) for x in found]
    return [replace(x, limit=limit) for x in out]


def as_paths(bgp: Bgp, rows: DataFrame) -> DataFrame:
    """(distance, template, match): each match as the text of its triples, for a union of templates."""
    word = lambda t: F.col(t[1:]) if is_var(t) else F.lit(t)
    match = F.concat_ws(" . ", *[F.concat_ws(" ", *map(word, p)) for p in bgp.patterns])
    return rows.select(F.lit(bgp.distance).alias("distance"), F.lit(bgp.name).alias("template"), match.alias("match"))


def chains(ends: list[str], longest: dict[str, int], triples: DataFrame | Stored, stop: set[str]) -> dict[tuple[str, int], DataFrame]:
    """(direction, k) -> (end, p1, n1 ... pk, nk): walks of k edges that go out from an end (``out``) or into it (``in``), each
    length made from the one before by one join and written once. Nodes in ``stop`` are not passed through."""
    t = triples if isinstance(triples, Stored) else Stored(triples, triples)

    def walk(way: str, table: DataFrame, a: str, b: str) -> dict[tuple[str, int], DataFrame]:
        made: dict[tuple[str, int], DataFrame] = {}
        for k in range(1, longest.get(way, 0) + 1):
            if k == 1:
                new = table.where(F.col(a).isin(ends)).select(F.col(a).alias("end"), F.col("p").alias("p1"), F.col(b).alias("n1"))
            else:
                last = made[way, k - 1]
                if stop:
                    last = last.where(~F.col(f"n{k - 1}").isin(*stop))
                new = table.select(F.col(a).alias(f"n{k - 1}"), F.col("p").alias(f"p{k}"), F.col(b).alias(f"n{k}")).join(small(last), f"n{k - 1}")
            made[way, k] = cut(new.select("end", *[f"{c}{i}" for i in range(1, k + 1) for c in "pn"]).distinct())
        return made

    out, back = together(lambda: walk("out", t.by_subject, "s", "o"), lambda: walk("in", t.by_object, "o", "s"))
    return out | back


def relate(queries: list[Bgp], triples: DataFrame | Stored) -> DataFrame:
    """(distance, template, match) of templates (``templates``): all of them are put together from the same walks, two of
    which meet in each match, so the graph is read once per direction and length and not once per pattern."""
    ends = sorted({e for q in queries for e in q.shape[:2]})
    longest: dict[str, int] = {}
    for q in queries:
        *_, a, b, how = q.shape
        for way, n in (("out" if how != "part" else "in", a), ("out" if how == "meet" else "in", b)):
            longest[way] = max(longest.get(way, 0), n)
    barred = [{y for x, y in q.differ if x == v and not is_var(y)} for q in queries for v in q.objects]
    walks = chains(ends, longest, triples, set.intersection(*barred) if barred else set())
    out = []
    for q in queries:
        first, second, a, b, how = q.shape
        left = walks["out" if how != "part" else "in", a].where(F.col("end") == first).drop("end")
        name = {f"p{k}": f"pf{k}" for k in range(1, a + 1)} | {f"n{k}": f"of{k}" for k in range(1, a)} | {f"n{a}": "middle" if how != "on" else f"of{a}"}
        rows = left.select(*[F.col(c).alias(n) for c, n in name.items()])
        if b == 0:
            rows = rows.where(F.col(f"of{a}") == second)
        else:
            right = walks["out" if how == "meet" else "in", b].where(F.col("end") == second).drop("end")
            d = a + b
            if how == "on":
                name = {f"p{k}": f"pf{d - k + 1}" for k in range(1, b + 1)} | {f"n{k}": f"of{d - k}" for k in range(1, b + 1)}
            else:
                name = {f"p{k}": f"ps{k}" for k in range(1, b + 1)} | {f"n{k}": f"os{k}" for k in range(1, b)} | {f"n{b}": "middle"}
            rows = rows.join(right.select(*[F.col(c).alias(n) for c, n in name.items()]), "middle" if how != "on" else f"of{a}")
        for x, y in q.differ:
            rows = rows.where(F.col(x[1:]) != (F.col(y[1:]) if is_var(y) else F.lit(y)))
        rows = rows.select(*[v[1:] for v in q.variables])
        out.append(as_paths(q, rows.orderBy(*rows.columns).limit(q.limit) if q.limit else rows))
    return reduce(DataFrame.unionByName, out)


def related_pairs(patterns: dict[str, Bgp], triples: DataFrame | Stored, first: str = "?e1", second: str = "?e2", limit: int | None = None) -> DataFrame:
    """(e1, e2, n_patterns, patterns): pairs by the number of patterns they match, the patterns joined by ``**``."""
    parts = []
    for name, b in patterns.items():
        rows = evaluate(replace(b, limit=None), triples, keep=[first, second]).select(F.col(first[1:]).alias("e1"), F.col(second[1:]).alias("e2"))
        if limit or b.limit:
            rows = rows.orderBy("e1", "e2").limit(limit or b.limit)
        parts.append(rows.withColumn("pattern", F.lit(name)))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n_patterns"), F.array_join(F.array_sort(F.collect_list("pattern")), "**").alias("patterns"))
