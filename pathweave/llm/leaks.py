"""Evaluation texts in a corpus: Wu-Manber multi-pattern search over words, in one scan of the corpus for any number of items.

The test strings are all runs of ``run`` words of the items. The search looks at the block of two words under the end of a
window of ``run`` words; the shift table says how far the window may move, ``run - 1`` words if no test string holds the
block. At shift 0 the window's hash is looked up in a table of bits of all test strings' hashes; the few windows that pass
go, with their words, to the bucket of test strings of the same hash (a join on the words), where direct comparison
confirms them. Both tables are built by the executors and have a bounded size whatever the number of items (a byte a slot
of blocks, at most ``MOST_BITS`` bits): blocks or strings that share an entry cost comparisons, never results.

A word is a run of letters and digits without case and accents; a word broken by a hyphen at a line end is one word.
Documents are read whole, once, and never shuffled; only windows that pass are. Defined results: null and empty texts hold
nothing; items shorter than ``run`` words can never be found, ``too_short`` names them; repeated rows give one result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import small

#: Slots of the shift table (a byte each), and bits of the table of test strings: 16 for each, within these bounds.
SLOTS, LEAST_BITS, MOST_BITS = 1 << 20, 1 << 16, 1 << 29

BROKEN = re.compile(r"(?<=[^\W_])[-­‐‑][ \t]*(?:\r\n|\n|\r)\s*(?=[^\W_])")
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    t = text.replace("\r\n", "\n")
    if "\n" in t:
        t = BROKEN.sub("", t)
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
        return WORD.findall(t.casefold())
    return WORD.findall(t.lower())


def shifts(w: list[str], run: int) -> dict[int, int]:
    """Slot -> least shift of the blocks of an item: a block that ends some test string has shift 0, those before that do not."""
    out: dict[int, int] = {}
    if len(w) >= run:
        for q in range(1, len(w)):
            b = slot(w[q - 1], w[q])
            out[b] = min(max(0, run - q - 1), out.get(b, run))
    return out


def slot(a: str, b: str) -> int:
    return zlib.crc32(f"{a} {b}".encode()) % SLOTS


def bit(string: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(string) % bits


def strings(w: list[str], run: int) -> list[str]:
    return [" ".join(w[k : k + run]) for k in range(len(w) - run + 1)]


class WuManber:
    """The search, from shifts (slot, shift) and the set bits of the test strings as (number of a group of 32, mask)."""

    def __init__(self, slots, groups, bits: int, run: int):
        if run < 4:
            raise ValueError("run is too short")
        shift = np.full(SLOTS, run - 1, np.uint8 if run < 256 else np.int32)
        if len(slots):
            at, to = np.asarray(slots).T
            shift[at] = to
        table = np.zeros(bits // 32, np.uint32)
        if len(groups):
            at, mask = np.asarray(groups, np.int64).T
            table[at] = mask
        self.run, self.bits, self.shift, self.table = run, bits, shift.tobytes() if run < 256 else shift.tolist(), table.tobytes()

    def windows(self, text: str | None) -> Iterator[tuple[int, str]]:
        """(end in words, words) of the windows that may be test strings; all that are, are among them."""
        if not text:
            return
        w = words(text)
        n, run, shift, table, bits, crc = len(w), self.run, self.shift, self.table, self.bits, zlib.crc32
        at = run
        while at <= n:
            s = shift[crc(f"{w[at - 2]} {w[at - 1]}".encode()) % SLOTS]
            if s:
                at += s
                continue
            string = " ".join(w[at - run : at])
            h = bit(string, bits)
            if table[h >> 3] >> (h & 7) & 1:
                yield at, string
            at += 1


def tables(todo: DataFrame, run: int) -> tuple[DataFrame, WuManber]:
    """(test strings (i, string), search) of the items ``todo`` (i, t)."""
    kind = todo.schema["i"].dataType.simpleString()

    def runs_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 1000):
                rows = [(i, x) for i, t in zip(f["i"].iloc[k : k + 1000], f["t"].iloc[k : k + 1000]) for x in set(strings(words(t), run))]
                yield pd.DataFrame(rows, columns=["i", "string"])

    def shifts_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 1000):
                rows = [x for t in f["t"].iloc[k : k + 1000] for x in shifts(words(t), run).items()]
                yield pd.DataFrame(rows, columns=["slot", "shift"])

    def bits_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h = np.array([bit(x, bits) for x in f["string"]], np.int64)
            yield pd.DataFrame({"g": h >> 5, "mask": np.int64(1) << (h & 31)})

    runs = cut(todo.mapInPandas(runs_of, f"i {kind}, string string").distinct())
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * runs.count()):
        bits *= 2
    slots = todo.mapInPandas(shifts_of, "slot int, shift int").groupBy("slot").agg(F.min("shift")).collect()  # at most SLOTS rows
    groups = runs.select("string").mapInPandas(bits_of, "g int, mask long").groupBy("g").agg(F.bit_or("mask")).collect()  # at most bits / 32 rows
    return runs, WuManber([tuple(r) for r in slots], [tuple(r) for r in groups], bits, run)


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = 12) -> DataFrame:
    """(d, i, t_hash, at): document, item and where (in words) a run that they share ends in the document; t_hash tells apart
    texts of one id."""
    todo = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    runs, search = tables(todo, run)
    tables_ = docs.sparkSession.sparkContext.broadcast(search)
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("t_hash")).where("t is not null")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wm = tables_.value
        for f in frames:
            rows = [(d, h, at, x) for d, t, h in zip(f["d"], f["t"], f["t_hash"]) for at, x in wm.windows(t)]
            yield pd.DataFrame(rows, columns=["d", "t_hash", "at", "string"])

    found = src.mapInPandas(scan, f"d {src.schema['d'].dataType.simpleString()}, t_hash long, at int, string string")
    return found.join(small(runs), "string").select("d", "i", "t_hash", "at")


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", **how) -> DataFrame:
    """(doc_id, item_id): the items each document holds."""
    return hits(docs, items, doc_id=doc_id, item_id=item_id, **how).select(F.col("d").alias(doc_id), F.col("i").alias(item_id)).distinct()


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", run: int = 12, **how) -> DataFrame:
    """(doc_id, item_id, n_words): the items each document holds and the longest run of words shared."""
    h = hits(docs, items, doc_id=doc_id, item_id=item_id, run=run, **how).distinct()
    in_turn = F.row_number().over(W.partitionBy("d", "i", "t_hash").orderBy("at"))  # a document has no more rows than words
    stretches = h.withColumn("g", F.col("at") - in_turn).groupBy("d", "i", "t_hash", "g").agg((F.count(F.lit(1)) + run - 1).cast("int").alias("n"))
    return stretches.groupBy(F.col("d").alias(doc_id), F.col("i").alias(item_id)).agg(F.max("n").alias("n_words"))


def too_short(items: DataFrame, item_id: str = "item_id", item_text: str = "text", run: int = 12) -> DataFrame:
    """(item_id, n_words) of the items of fewer words than ``run``, which no document can be found to hold; null texts have none."""
    src = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({item_id: f["i"], "n_words": [len(words(t)) if isinstance(t, str) else 0 for t in f["t"]]})

    return src.mapInPandas(count, f"`{item_id}` {src.schema['i'].dataType.simpleString()}, n_words int").where(F.col("n_words") < run)
