"""CSV text of query results: records of texts that come in chunks, with a header line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import running

END = "\r\n|\n|\r"


def records(chunks: DataFrame, query: str, order: str, text: str) -> DataFrame:
    """(query, record_no, record): the non-empty lines of each query's text, which comes in chunks that end anywhere.

    A chunk is split by itself; its pieces are numbered by the line ends before them, counted by a running sum over the
    chunk numbers (``order``, integers, unique within a query), and the pieces of a line are joined. No text of a query is
    put together as a whole. Empty lines count in ``record_no`` and are left out; a CR and LF in two chunks make an empty line.
    """
    c = chunks.where(F.col(text).isNotNull()).select(query, F.col(order).cast("long").alias("__at"), F.split(text, END).alias("__pieces"))
    ends = running(c.select(query, "__at", (F.size("__pieces") - 1).alias("__n")), [query], "__at", "__n", "__ends")
    pieces = c.join(ends.select(query, "__at", (F.col("__ends") - F.col("__n")).alias("__before")), [query, "__at"]).select(query, "__at", "__before", F.posexplode("__pieces").alias("__k", "__piece"))
    lines = pieces.groupBy(query, (F.col("__before") + F.col("__k")).alias("record_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__piece"))), lambda x: x["__piece"]), "").alias("record"))  # the pieces of one line
    return lines.where("record <> ''")


def rows(recs: DataFrame, query: str, variables: list[str]) -> DataFrame:
    """(query, record_no, variables...): records read by ``from_csv``; the first record of a query is the header and is left out."""
    schema = ", ".join(f"`{v}` string" for v in variables)
    first = recs.groupBy(query).agg(F.min("record_no").alias("__first"))
    return recs.join(first, query).where(F.col("record_no") > F.col("__first")).select(query, "record_no", F.from_csv("record", schema).alias("r")).select(query, "record_no", "r.*")
