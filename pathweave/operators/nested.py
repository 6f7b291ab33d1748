"""Nested documents to flat tables by Dewey labels.

Each node of a document gets the path of its ordinals from the root (``2.1.3``: third child of the first child of the
second entry), so the parent's label is the label without its last step and needs no lookup, and document order is the
order of labels. Nodes are grouped by their schema path into one table per path. Everything happens in the row of the
document: no shuffle, no join.

Shapes: a list of one may be written without its list, a list or object may be written as JSON text, entries of a map
may be written as a list of objects that name their key, and an object may be written as an array of its fields in
order. All are given the same labels. Defined results: null or malformed text gives no nodes (``malformed`` tells
which); empty lists give none; absent fields are absent from ``fields``; fields that the spec does not name are kept.
Nothing is dropped: elements of an array beyond its names, and the earlier values of a field that is written twice, are
kept in the field ``extra`` (a JSON list); a map key written twice gives two entries, a list written twice is continued.
Ordinals count every entry written, including nulls and entries that hold nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch


@dataclass(frozen=True)
class Entries:
    """Schema of a list (or, with ``key``, of a map) of objects. ``path``: name of the table of its entries."""

    path: str
    key: str | None = None
    children: dict[str, "Entries"] = field(default_factory=dict)
    #: Field names by position and number of elements, for objects written as arrays.
    arrays: dict[int, tuple[str, ...]] = field(default_factory=dict)
    #: Whether a list whose first element is a scalar is one object of the list, not a list of values.
    alone: bool = False


#: The statement documents of an entity: property -> {name, ntype, list_statement: [{url, value, list: [...]}]}.
QUALIFIERS = Entries("property.statement.qualifier", arrays={0: (), 1: ("property",), 2: ("property", "name"), 3: ("property", "name", "value"), 4: ("property", "name", "url", "value")}, alone=True)
STATEMENTS = Entries("property.statement", children={"list": QUALIFIERS}, arrays={0: (), 1: ("url",), 2: ("url", "value"), 3: ("url", "value", "list")})
STATEMENT_DOCUMENT = Entries("property", key="property", children={"list_statement": STATEMENTS})

NODE_SCHEMA = "dewey string, parent string, path string, ordinal int, keys array<string>, fields map<string,string>"


class Repeated(dict):
    """An object with a field written more than once: the last values, and all ``pairs`` as written."""

    pairs: list


def _object(pairs: list) -> dict:
    d = dict(pairs)
    if len(d) < len(pairs):
        d = Repeated(d)
        d.pairs = pairs
    return d


def _pairs(d: dict) -> list:
    return d.pairs if isinstance(d, Repeated) else list(d.items())


def _child(d: dict, f: str):
    """The entries under ``f``; of a field written more than once, those of all its values."""
    if not isinstance(d, Repeated):
        return _loaded(d.get(f))
    values = [_loaded(v) for k, v in d.pairs if k == f and v is not None]
    if len(values) < 2:
        return values[0] if values else None
    return [x for v in values for x in (v if isinstance(v, list) and not (v and not isinstance(_loaded(v[0]), (dict, list))) else [v])]


def _loaded(x):
    """Text that holds a JSON list or object, parsed; anything else as it is."""
    if isinstance(x, str) and x.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(x, object_pairs_hook=_object)
        except ValueError:
            return x
    return x


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def label(document: str | None, spec: Entries) -> list[tuple]:
    """Nodes of one document: (dewey, parent, path, ordinal, keys of the map ancestors, scalar fields)."""
    if document is None:
        return []
    try:
        root = json.loads(document, object_pairs_hook=_object)
    except (ValueError, RecursionError):
        return []
    out: list[tuple] = []
    stack = [(_loaded(root), spec, "", ())]
    while stack:
        value, s, at, keys = stack.pop()
        if value is None:
            continue
        if isinstance(value, dict):
            if s.key and not (s.key in value and not isinstance(value[s.key], (dict, list))):
                entries = _pairs(value)
            else:
                entries = [(None, value)]
        elif isinstance(value, list):
            # an object written as an array stands alone if its elements are scalars and it has a known width
            alone = s.alone and value and not any(isinstance(_loaded(v), (dict, list)) or v is None for v in value[:1])
            entries = [(None, value)] if alone else [(None, v) for v in value]
        else:
            continue  # a bare scalar where entries are expected holds no fields
        for n, (k, v) in enumerate(entries, 1):
            v = _loaded(v)
            extra: list = []
            if isinstance(v, list):
                if s.key and s.children:
                    v = {next(iter(s.children)): v}
                else:
                    names = s.arrays.get(len(v)) or max(s.arrays.values(), key=len, default=())
                    v, extra = dict(zip(names, v)), v[len(names) :]
            elif not isinstance(v, dict):
                v = {} if v is None else {"value": v}
            elif isinstance(v, Repeated):
                left = dict(v)
                for f, x in reversed(v.pairs):
                    if f not in s.children and left.pop(f, None) is None:
                        extra.insert(0, x)
            if s.key and k is None and not isinstance(v.get(s.key), (dict, list)):
                k = v.get(s.key)
            mine = f"{at}.{n}" if at else str(n)
            here = keys + (_text(k),) if s.key else keys
            scalars = {f: _text(x) for f, x in v.items() if f not in s.children}
            if s.key and k is not None:
                scalars.setdefault(s.key, _text(k))
            if extra:
                scalars["extra"] = json.dumps(([scalars["extra"]] if "extra" in scalars else []) + extra, ensure_ascii=False)
            out.append((mine, at or None, s.path, n, list(here), scalars))
            stack += [(_child(v, f), c, mine, here) for f, c in s.children.items() if v.get(f) is not None or isinstance(v, Repeated)]
    return out


def dewey_nodes(df: DataFrame, id_col: str, json_col: str, spec: Entries = STATEMENT_DOCUMENT) -> DataFrame:
    """(id, dewey, parent, path, ordinal, keys, fields): a row per node of every row of ``df``."""
    src = df.select(F.col(id_col), F.col(json_col).alias("__json"))
    kind = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                row, nodes = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    found = label(text, spec)
                    nodes += found
                    row += [k] * len(found)
                dewey, parent, path, ordinal, keys, fields = zip(*nodes) if nodes else ((),) * 6
                ends = np.cumsum([0, *map(len, fields)])
                maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([f for x in fields for f in x], pa.string()), pa.array([v for x in fields for v in x.values()], pa.string()))
                arrays = [part.column(0).take(pa.array(row, pa.int64())), pa.array(dewey, pa.string()), pa.array(parent, pa.string()), pa.array(path, pa.string()), pa.array(ordinal, pa.int32()), pa.array(keys, pa.list_(pa.string())), maps]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "dewey", "parent", "path", "ordinal", "keys", "fields"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, {NODE_SCHEMA}")


def node_table(nodes: DataFrame, path: str, columns: dict[str, str]) -> DataFrame:
    """One flat table: the nodes of ``path`` with ``columns`` (output name -> field name)."""
    keep = [c for c in nodes.columns if c not in ("path", "keys", "fields", "parent", "dewey", "ordinal")]
    return nodes.where(F.col("path") == path).select(*keep, "dewey", F.col("parent").alias("parent_dewey"), "ordinal", *[F.col("fields")[f].alias(n) for n, f in columns.items()])


def flat_tables(df: DataFrame, id_col: str, json_col: str, tables: dict[str, dict[str, str]], spec: Entries = STATEMENT_DOCUMENT) -> dict[str, DataFrame]:
    """The table of each schema path of ``tables`` (path -> output name -> field name). Documents are parsed once: the nodes
    are written in a folder per path, of which each table reads its own."""
    path = scratch(df.sparkSession, "nodes")
    nodes = dewey_nodes(df, id_col, json_col, spec)
    nodes.write.partitionBy("path").parquet(path)
    back = df.sparkSession.read.schema(nodes.schema).parquet(path)
    return {p: node_table(back, p, columns) for p, columns in tables.items()}


def malformed(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Ids of the rows whose text is no JSON."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bad = []
            for i, text in zip(f[id_col], f["__json"]):
                try:
                    text is None or json.loads(text)
                except (ValueError, RecursionError):
                    bad.append(i)
            yield pd.DataFrame({id_col: pd.Series(bad, dtype=f[id_col].dtype)})

    src = df.select(F.col(id_col), F.col(json_col).alias("__json"))
    return src.mapInPandas(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}")


def filled(c):
    """Not null and not the empty text."""
    return F.coalesce(c != "", F.lit(False))


def flat_statements(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, flat_prop, stmt_no, qual_no, url, value): ``p:P/ps:P`` for statements, ``p:P/pq:Q`` for qualifiers."""
    code = lambda c: F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    f = F.col("fields")
    prop = code(F.element_at("keys", 1))
    steps = F.split("dewey", r"\.")
    is_st = F.col("path") == STATEMENTS.path
    return (
        nodes.where(F.col("path").isin(STATEMENTS.path, QUALIFIERS.path))
        .where(filled(prop) & (filled(f["url"]) | filled(f["value"])) & (is_st | filled(code(f["property"]))))
        .select(
            id_col,
            F.when(is_st, F.concat(F.lit("p:"), prop, F.lit("/ps:"), prop)).otherwise(F.concat(F.lit("p:"), prop, F.lit("/pq:"), code(f["property"]))).alias("flat_prop"),
            F.element_at(steps, 2).cast("int").alias("stmt_no"),
            F.when(is_st, F.lit(0)).otherwise(F.element_at(steps, -1).cast("int")).alias("qual_no"),
            f["url"].alias("url"),
            f["value"].alias("value"),
        )
    )
