"""Entity pages: property tables and links. HTML need not be well formed; the parser of the standard library reads it.

A row of the table names a property in its odd cells (the address of the link of class ``uri``) and its values in its
even cells (list items: the addresses of links, and literals marked ``property`` that are English or untagged). A row
whose first cell has further text after the link ("is ... of") is an inverse row. Forward and inverse values of one
property are kept apart (``ntype`` above 2 marks the inverse).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hrefs


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, str]] = []
        self.row = self.keep = False
        self.cell, self.prop, self.ntype, self.values, self.text = 0, None, 0, [], []
        self.in_item = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self._end_row()
            self.row, self.cell, self.prop, self.ntype, self.values = True, 0, None, 0, []
        elif tag == "td" and self.row:
            self.cell += 1
        elif self.row and tag == "li":
            self.in_item = True
        elif self.row and tag == "a" and "uri" in (a.get("class") or "").split():
            if self.cell % 2 and self.cell:
                self.prop = self.prop or a.get("href")
            elif self.cell and a.get("href"):
                self.values.append(a["href"])
        elif self.row and self.cell and self.cell % 2 == 0 and "property" in a:
            self.keep, self.text = (a.get("xml:lang") or "en") == "en", []

    def handle_endtag(self, tag):
        if tag == "span" and self.keep:
            if "".join(self.text).strip():
                self.values.append("".join(self.text).strip())
            self.keep = False
        elif tag == "tr":
            self._end_row()
        elif tag == "li":
            self.in_item = False

    def handle_data(self, data):
        if self.keep:
            self.text.append(data)
        elif self.row and self.cell % 2 and data.strip():
            self.ntype += 1

    def _end_row(self):
        if self.row and self.prop:
            self.rows += [(self.prop, self.ntype, v) for v in self.values]
        self.row = self.keep = False

    def close(self):
        super().close()
        self._end_row()


def property_table(html: str | None) -> list[tuple[str, int, str]]:
    """(property, ntype, value) in order; nothing for null or pages without such a table."""
    if not html:
        return []
    p = _Table()
    p.feed(html)
    p.close()
    return p.rows


def parse_pages(pages: DataFrame, entity: str, html: str) -> DataFrame:
    """(entity, p, ntype, value) of each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(e, p, n, v) for e, h in zip(f["e"], f["h"]) for p, n, v in property_table(h)], columns=["entity", "p", "ntype", "value"])

    return pages.select(F.col(entity).alias("e"), F.col(html).alias("h")).mapInPandas(run, "entity string, p string, ntype int, value string")


def links(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, href): every link of a page, repetitions included."""
    return pages.select(F.col(page).alias("page"), F.explode(hrefs(F.col(html))).alias("href"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Documents (entity, ...) of ``first``; those of ``second`` for entities that have no link in ``first``."""
    linked = first.where(F.col("value").startswith("http")).select("entity").distinct()
    return first.join(linked, "entity", "left_semi").unionByName(second.join(linked, "entity", "left_anti"))


class _Statements(HTMLParser):
    """Statement pages, by the class names of their blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.description = "", ""
        self.groups: list[dict] = []
        self.open: list[tuple[str, str]] = []
        self.snak: list | None = None

    # Class names of the blocks of a statement page.
    GROUP, STATEMENT, MAIN, QUALIFIERS, PROPERTY, VALUE = "wikibase-statementgroupview", "wikibase-statementview", "wikibase-statementview-mainsnak", "wikibase-statementview-qualifiers", "wikibase-snakview-property", "wikibase-snakview-value"
    TITLE, DESCRIPTION, GROUP_PROPERTY = "wikibase-title-label", "wikibase-descriptionview-text", "wikibase-statementgroupview-property"
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def _inside(self, cls: str) -> bool:
        return any(cls in c.split() for _, c in self.open)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        cls = a.get("class") or ""
        names = cls.split()
        if tag not in self.VOID:
            self.open.append((tag, cls))
        if self.GROUP in names:
            self.groups.append({"property": a.get("id"), "name": None, "list_statement": []})
        elif self.STATEMENT in names and self.groups:
            self.groups[-1]["list_statement"].append({"url": None, "value": None, "list": []})
        elif self.PROPERTY in names and self._inside(self.QUALIFIERS) and self.groups and self.groups[-1]["list_statement"]:
            self.groups[-1]["list_statement"][-1]["list"].append([None, None, None, None])
        if tag == "a" and self.groups:
            code = re.search(r"(?:Property:)?([PQ]\d+)$", a.get("href") or a.get("title") or "")
            if code and self.groups[-1]["list_statement"]:
                st = self.groups[-1]["list_statement"][-1]
                if self._inside(self.QUALIFIERS) and st["list"]:
                    st["list"][-1][0 if self._inside(self.PROPERTY) else 2] = code[1]
                elif self._inside(self.MAIN):
                    st["url"] = code[1]

    def handle_endtag(self, tag):
        while self.open:
            if self.open.pop()[0] == tag:
                break

    def handle_data(self, data):
        """Text comes in pieces, parted by tags within it; they are joined here and their white space tidied in ``close``."""
        if self._inside(self.TITLE):
            self.title += data
        elif self._inside(self.DESCRIPTION):
            self.description += data
        elif self._inside(self.GROUP_PROPERTY) and self.groups:
            self.groups[-1]["name"] = (self.groups[-1]["name"] or "") + data
        elif self.groups and self.groups[-1]["list_statement"]:
            st = self.groups[-1]["list_statement"][-1]
            if self._inside(self.QUALIFIERS) and st["list"]:
                q, k = st["list"][-1], 1 if self._inside(self.PROPERTY) else 3
                if k == 1 or self._inside(self.VALUE):
                    q[k] = (q[k] or "") + data
            elif self._inside(self.MAIN) and self._inside(self.VALUE):
                st["value"] = (st["value"] or "") + data

    def close(self):
        super().close()
        tidy = lambda x: " ".join((x or "").split()) or None
        self.title, self.description = tidy(self.title) or "", tidy(self.description) or ""
        for g in self.groups:
            g["name"] = tidy(g["name"])
            for st in g["list_statement"]:
                st["value"] = tidy(st["value"])
                st["list"] = [[q[0], tidy(q[1]), q[2], tidy(q[3])] for q in st["list"]]


def statement_document(html: str | None) -> tuple[str, str, dict]:
    """(title, description, {property: {name, list_statement}}) of a statement page."""
    if not html:
        return "", "", {}
    p = _Statements()
    p.feed(html)
    p.close()
    doc: dict = {}
    for g in p.groups:
        for st in g["list_statement"]:
            st["list"] = [[q[0], q[1], q[2], q[3]] if q[2] else [q[0], q[1], q[3]] for q in st["list"]]
        if g["property"]:
            doc.setdefault(g["property"], {"name": g["name"], "list_statement": []})["list_statement"] += g["list_statement"]
    return p.title, p.description, doc


def parse_statement_pages(pages: DataFrame, entity: str, html: str) -> DataFrame:
    """(entity, title, description, document): the document as JSON text for ``operators.nested``."""
    import json

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(e, t, d, json.dumps(doc, ensure_ascii=False)) for e, h in zip(f["e"], f["h"]) for t, d, doc in [statement_document(h)]]
            yield pd.DataFrame(rows, columns=["entity", "title", "description", "document"])

    return pages.select(F.col(entity).alias("e"), F.col(html).alias("h")).mapInPandas(run, "entity string, title string, description string, document string")
