"""RDF/XML documents to (entity, p, ntype, value) rows.

``rdf:about`` sets the subject; ``rdf:resource`` or text gives the value. A value that is the entity itself belongs to an
inverse statement: ntype 4 and the other subject as value. Malformed documents give nothing (``ok`` tells).
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def triples(xml: str | None, entity: str) -> list[tuple[str, int, str]] | None:
    """(property, ntype, value); None if the text is no XML."""
    if not xml:
        return []
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    out = []
    for d in root.iter(RDF + "Description"):
        subject = d.get(RDF + "about")
        for child in d:
            uri = child.tag.replace("{", "").replace("}", "")
            res = child.get(RDF + "resource")
            if res is not None and res == entity and subject != entity:
                out.append((uri, 4, subject))
            elif res is not None:
                out.append((uri, 1, res))
            elif (child.text or "").strip() and (child.get(LANG) or "en") == "en":
                out.append((uri, 1, child.text.strip()))
    return out


def parse_rdfxml(docs: DataFrame, entity: str, xml: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(e, p, n, v) for e, x in zip(f["e"], f["x"]) for p, n, v in triples(x, e) or []], columns=["entity", "p", "ntype", "value"])

    return docs.select(F.col(entity).alias("e"), F.col(xml).alias("x")).mapInPandas(run, "entity string, p string, ntype int, value string")


RESULT = "{http://www.w3.org/2005/sparql-results#}"


def result_rows(xml: str | None) -> list[dict[str, str]]:
    """Bindings by variable name of each result; nothing for null or malformed text."""
    try:
        root = ET.fromstring(xml) if xml else None
    except ET.ParseError:
        root = None
    if root is None:
        return []
    return [{b.get("name"): "".join(b.itertext()).strip() for b in r.iter(RESULT + "binding")} for r in root.iter(RESULT + "result")]


def sparql_results(docs: DataFrame, key: str, xml: str, variables: list[str]) -> DataFrame:
    """(key, row_no, variables...): a row per result, null where a variable is not bound."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, *[r.get(v) for v in variables]) for k, x in zip(f["k"], f["x"]) for n, r in enumerate(result_rows(x), 1)]
            yield pd.DataFrame(rows, columns=[key, "row_no", *variables])

    schema = f"`{key}` string, row_no int, " + ", ".join(f"`{v}` string" for v in variables)
    return docs.select(F.col(key).cast("string").alias("k"), F.col(xml).alias("x")).mapInPandas(run, schema)


def expand_names(df: DataFrame, name: str, namespaces: DataFrame, out: str = "uri") -> DataFrame:
    """``prefix:name`` with its namespace; null where the prefix is unknown. ``namespaces``: prefix, uri."""
    ns = namespaces.select(F.col("prefix").alias("__prefix"), F.col("uri").alias("__uri"))
    keyed = df.withColumn("__prefix", F.substring_index(name, ":", 1))
    rest = F.expr(f"substring(`{name}`, instr(`{name}`, ':') + 1)")
    return keyed.join(small(ns), "__prefix", "left").withColumn(out, F.concat("__uri", rest)).drop("__prefix", "__uri")
