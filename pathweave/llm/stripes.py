"""How often items stand in one record, against chance: the stripes method with the log-likelihood ratio.

Each task keeps, per item, an associative array of the items met with it (the item's stripe) and sends on whole stripes.
Stripes are merged by key: the arrays of an item meet, sorted next to one another, and are added up entry by entry. A
stripe is cut into slices by hash of the neighbour, as many as keep a slice near ``SLICE`` entries given the number of
different items, so that no merge holds more than a slice, however long a stripe is; the slices of an item go to
different tasks. Only the smaller of two items has the pair in its stripe, and records are counted per item before.

Defined results: null and blank items are skipped, repeated items of a record count once, records without items do not
count, repeated ids count once (null ids as one), an empty table gives no pairs. Equal counts are all kept.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import clean_code, small

#: Entries of all stripes a task keeps before it sends them on, and expected entries of a slice at most.
FLUSH, SLICE = 500_000, 4096
STRIPE = "item string, slice int, who array<string>, many array<long>"


def records(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(items): the sorted distinct clean codes of each distinct id."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform(list_col, clean_code), lambda x: x.isNotNull())))
    return df.select(F.col(id_col).alias("id"), items.alias("items")).where(F.size("items") > 0).dropDuplicates(["id"]).select("items")


def _rows(kept: dict[tuple[str, int], Counter]) -> pd.DataFrame:
    return pd.DataFrame([(item, k, list(c), list(c.values())) for (item, k), c in kept.items()], columns=["item", "slice", "who", "many"])


def cooccurrence(recs: DataFrame) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n) of all pairs a < b that share a record."""
    flush = FLUSH
    recs = cut(recs)
    single = cut(recs.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("m")))
    total = recs.count()
    slices = max(1, -(-single.count() // SLICE))

    def stripes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: defaultdict[str, Counter] = defaultdict(Counter)
        entries = 0

        def rows() -> pd.DataFrame:
            out: defaultdict[tuple[str, int], Counter] = defaultdict(Counter)
            for item, stripe in kept.items():
                for who, m in stripe.items():
                    out[item, zlib.crc32(who.encode()) % slices][who] = m
            kept.clear()
            return _rows(out)

        for f in frames:
            for items in f["items"]:
                items = items.tolist()
                for k, a in enumerate(items[:-1]):
                    kept[a].update(items[k + 1 :])
                entries += len(items) * (len(items) - 1) // 2
                if entries > flush:
                    entries = sum(map(len, kept.values()))
                    if entries > flush:
                        yield rows()
                        entries = 0
        yield rows()

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds up neighbouring rows of a slice; a frame's last slice may go on in the next frame."""
        at, sums = None, Counter()
        for f in frames:
            done: dict = {}
            for item, k, who, many in zip(f["item"], f["slice"], f["who"], f["many"]):
                if (item, k) != at:
                    if sums:
                        done[at] = sums
                    at, sums = (item, k), Counter()
                for w, m in zip(who, many):
                    sums[w] += m
            if done:
                yield _rows(done)
        if sums:
            yield _rows({at: sums})

    merged = recs.mapInPandas(stripes, STRIPE).repartition("item", "slice").sortWithinPartitions("item", "slice").mapInPandas(merge, STRIPE)
    pairs = merged.select(F.col("item").alias("a"), F.explode(F.arrays_zip("who", "many")).alias("e")).select("a", F.col("e.who").alias("b"), F.col("e.many").alias("n_ab"))
    counts = lambda x: small(single.select(F.col("item").alias(x), F.col("m").alias(f"n_{x}")))
    return pairs.join(counts("a"), "a").join(counts("b"), "b").withColumn("n", F.lit(total).cast("long"))


def lift() -> Column:
    return F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))


def log_likelihood() -> Column:
    """Dunning's G2 of the 2 x 2 table of a pair; signed: negative if the pair is rarer than by chance."""
    n, ab, a, b = (F.col(x).cast("double") for x in ("n", "n_ab", "n_a", "n_b"))
    cells = [(ab, a * b), (a - ab, a * (n - b)), (b - ab, (n - a) * b), (n - a - b + ab, (n - a) * (n - b))]
    term = lambda k, e: F.when(k > 0, k * F.log(k * n / e)).otherwise(0.0)
    g = 2 * sum((term(k, e) for k, e in cells), F.lit(0.0))
    return F.when(ab * n < a * b, -g).otherwise(g)


def significant(level: float) -> Column:
    """Whether a pair stands together more often than by chance, at ``level``: G2 beyond the quantile of chi square with one degree."""
    return log_likelihood() > NormalDist().inv_cdf(1 - level / 2) ** 2
