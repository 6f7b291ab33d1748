"""Parameters of a search and of a knowledge base."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchConfig:
    """``length``: most edges of a path. ``max_links``: nodes with as many links or more are not expanded (endpoints and
    the first level are exempt). ``ignored_properties``/``ignored_nodes`` take no part. ``domain``: a table of nodes
    that may be entered, as the name of a column of codes, is passed to the search itself. ``max_rows``: refuse a level
    that would have more rows than this (None: no guard)."""

    length: int = 4
    max_links: int | None = 30_000
    ignored_properties: tuple[str, ...] = ()
    ignored_nodes: tuple[str, ...] = ()
    max_rows: int | None = None

    @property
    def left(self) -> int:
        return -(-self.length // 2)

    @property
    def right(self) -> int:
        return self.length // 2


@dataclass(frozen=True)
class KnowledgeBase:
    """What is particular to a source: the prefix of its entities, words of its domain, from which ntype on a property is inverse."""

    entity_prefix: str = "http://dbpedia.org/resource/"
    keywords: tuple[str, ...] = ()
    inverse_above: int = 2
    item_pattern: str = "^http"


DBPEDIA = KnowledgeBase()
WIKIDATA = KnowledgeBase(entity_prefix="Q", item_pattern="^Q")
