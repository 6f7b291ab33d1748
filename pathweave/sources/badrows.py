"""CSV records with faults: bulk columnar parse of blocks, bisection of blocks that fail, strict diagnosis of bad records.

The records of a batch with the same header are tried as one block, against one expression for a record of that header
(its form, and the domains of its fields). A block that fails is halved and each half is tried again, down to single
records, so what is left are the bad records, which a strict grammar diagnoses one by one; all others go through the
columnar CSV reader at once. Days are tried as a whole column, too, and halved where they fail. A block is tried with its
records joined by a character that no record of it holds, so no fault can hide in its neighbour, and the result does not
depend on the sizes of blocks.

Grammar and reasons: one line end (CR LF, LF or CR) at the end of a record is ignored. Reasons, the first that applies:
``quoting`` (the record cannot be split), ``column_count`` (null or blank text, null header, or another number of
fields than the header names), ``invalid_value`` (a field is outside the domain of its variable). A text of blanks can be
split; one that still holds a line end when its own is taken off cannot, even if it is blank besides. Good records have
reason null and their fields as a map. An empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import datetime
import io
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Domain of each variable of a result header; variables that are not named here are any text.
IRI = r'^https?://[^\s<>"]+$'
DOMAINS = {
    "s": IRI, "p": IRI, "e1": IRI, "e2": IRI, "class": IRI,
    "n": r"^[0-9]+$",
    "score": r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$",
    "d": "date",
}
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
#: Stands between the records of a block; texts that hold it are diagnosed one by one.
BETWEEN = "\0"
FIELD = re.compile(r'"((?:[^"]|"")*)"|([^",\r\n]*)')


def split_record(text: str) -> list[str] | None:
    """Fields of one record without its line end; None if the grammar does not fit."""
    out, i, n = [], 0, len(text)
    while True:
        m = FIELD.match(text, i)
        out.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        i = m.end()
        if i == n:
            return out
        if text[i] != ",":
            return None
        i += 1


def strip_end(text: str) -> str:
    return text[:-2] if text.endswith("\r\n") else text[:-1] if text[-1:] in ("\n", "\r") else text


def valid(variable: str, value: str, domains: dict[str, str] = DOMAINS) -> bool:
    rule = domains.get(variable)
    if rule is None:
        return True
    if rule != "date":
        return re.fullmatch(rule[1:-1], value) is not None
    if not re.fullmatch(DAY[1:-1], value):
        return False
    try:
        datetime.date.fromisoformat(value)
        return True
    except ValueError:
        return False


def diagnose(header: str | None, text: str | None, domains: dict[str, str] = DOMAINS) -> tuple[str | None, list[str] | None]:
    """(reason or None, fields or None) by the strict grammar."""
    if text is None or header is None:
        return "column_count", None
    fields = split_record(strip_end(text))
    if fields is None:
        return "quoting", None
    names = [h.strip() for h in header.split(",")]
    if len(fields) != len(names) or not text.strip():
        return "column_count", None
    if not all(valid(h, v, domains) for h, v in zip(names, fields)):
        return "invalid_value", None
    return None, fields


@cache
def block_form(names: tuple[str, ...], domains: tuple[tuple[str, str], ...]) -> re.Pattern:
    """Of a block of records, each of which is not blank and has the fields named, all in their domains but for the calendar."""
    rules = dict(domains)

    def one(name: str) -> str:
        rule = rules.get(name)
        if rule is None:
            return f'(?>"(?:[^"{BETWEEN}]|"")*+"|[^",\\r\\n{BETWEEN}]*+)'
        if rule == "date":
            value = bare = "(?!0000)" + DAY[1:-1]
        else:
            value, bare = rule[1:-1].replace("[^", f"[^{BETWEEN}"), rule[1:-1].replace("[^", f"[^{BETWEEN},")
        return f'(?>"(?>{value})"|(?>{bare}))'

    record = rf"(?=\s*+[^\s{BETWEEN}])" + ",".join(map(one, names))
    return re.compile(f"(?:{record}{BETWEEN})*+{record}")


def _days(column: pa.Array, a: int, b: int, bad: list[int]) -> None:
    """Numbers of the values from a to b that are no days, found by halving."""
    try:
        pc.cast(column.slice(a, b - a), pa.date32())
    except pa.ArrowInvalid:
        if b - a == 1:
            bad.append(a)
        else:
            _days(column, a, (a + b) // 2, bad)
            _days(column, (a + b) // 2, b, bad)


def read_block(names: list[str], texts: list[str | None], domains: dict[str, str] = DOMAINS) -> tuple[list[int], list[pa.Array]]:
    """(numbers of the good records, their columns)."""
    form = block_form(tuple(names), tuple(domains.items()))
    whole = [k for k, x in enumerate(texts) if x is not None and BETWEEN not in x]
    lines = [strip_end(texts[k]) for k in whole]
    good: list[int] = []
    stack = [(0, len(whole))] if whole else []
    while stack:
        a, b = stack.pop()
        if form.fullmatch(BETWEEN.join(lines[a:b])):
            good += range(a, b)
        elif b - a > 1:
            stack += [((a + b) // 2, b), (a, (a + b) // 2)]
    if not good:
        return [], []
    try:
        blob = "\n".join([lines[k] for k in good]).encode()
    except UnicodeEncodeError:
        return [], []
    t = pacsv.read_csv(
        io.BytesIO(blob),
        read_options=pacsv.ReadOptions(column_names=[str(i) for i in range(len(names))], use_threads=False, block_size=len(blob) + 1024),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
        convert_options=pacsv.ConvertOptions(column_types={str(i): pa.string() for i in range(len(names))}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    )
    if t.num_rows != len(good):
        raise RuntimeError("the columnar reader and the form of records disagree")
    columns = [c.combine_chunks() for c in t.columns]
    bad: list[int] = []
    for name, c in zip(names, columns):
        if domains.get(name) == "date":
            _days(c, 0, len(c), bad)
    if bad:
        keep = sorted(set(range(len(good))) - set(bad))
        good, columns = [good[k] for k in keep], [c.take(pa.array(keep, pa.int64())) for c in columns]
    return [whole[k] for k in good], columns


def parse_block(header: str, texts: list[str | None], domains: dict[str, str] = DOMAINS) -> list[tuple[str | None, list[str] | None]]:
    """(reason, fields) of each record of a block with one header."""
    good, columns = read_block([h.strip() for h in header.split(",")], texts, domains)
    rows = dict(zip(good, map(list, zip(*[c.to_pylist() for c in columns]))))
    return [(None, rows[k]) if k in rows else diagnose(header, x, domains) for k, x in enumerate(texts)]


#: Most records of a block.
LARGEST = 16_384


def _maps(names: list[str], columns: list[pa.Array]) -> pa.Array:
    """The records of these columns as maps."""
    n, k = len(columns[0]), len(names)
    items = pa.concat_arrays(columns).take(pa.array((np.arange(n)[:, None] + np.arange(k) * n).ravel()))
    keys = pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(k), n)))
    return pa.MapArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), keys, items)


def load_records(df: DataFrame, header: str = "header", text: str = "texto", domains: dict[str, str] = DOMAINS) -> DataFrame:
    """``df`` with ``reason`` (null for good records) and ``fields`` (variable -> value, null for bad ones). No shuffle.

    With empty ``domains`` any value is good, and only the form of the records counts.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("reason", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
    if {"reason", "fields"} & set(df.columns):
        raise ValueError("columns named reason or fields would clash; rename them first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            for start in range(0, every.num_rows, LARGEST):
                b = every.slice(start, LARGEST)
                heads, texts = b.column(header).to_pylist(), b.column(text).to_pylist()
                by: dict = {}
                for k, h in enumerate(heads):
                    by.setdefault(h, []).append(k)
                reason, place, maps, size = [None] * len(heads), [None] * len(heads), [pa.array([], pa.map_(pa.string(), pa.string()))], 0
                for h, ks in by.items():
                    names = [] if h is None else [x.strip() for x in h.split(",")]
                    good, columns = read_block(names, [texts[k] for k in ks], domains) if names else ([], [])
                    for n, g in enumerate(good, size):
                        place[ks[g]] = n
                    if good:
                        maps.append(_maps(names, columns))
                        size += len(good)
                    for k in ks:
                        if place[k] is None:
                            why, fields = diagnose(h, texts[k], domains)
                            reason[k] = why
                            if why is None:  # good, but not for the reader (such as a text with a null character)
                                place[k] = size
                                maps.append(_maps(names, [pa.array([f], pa.string()) for f in fields]))
                                size += 1
                fields = pa.concat_arrays(maps).take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reason, pa.string()), fields], names=[*b.schema.names, "reason", "fields"])

    return df.mapInArrow(run, schema)
