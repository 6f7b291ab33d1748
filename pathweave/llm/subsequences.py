"""Closed frequent subsequences (gaps allowed) by prefix growth with bidirectional extension checks and backscan pruning.

Work is partitioned by first item: the sequences that hold an item go, once, to that item's partition, in parts of about
``PART_ROWS`` so that no task gets all of a hot item's, packed in blocks of one first item (a row each, of at most ``CELLS`` cells
where a single sequence is not longer). The blocks stay as they are for all levels. A pseudo-projection is a pair of arrays within a
block's task: the numbers of the sequences that hold the prefix and the ends of its matches; nothing is copied into
suffixes and nothing of it is written or moved. For each prefix of a level the items of three kinds of stretches are
counted over whole blocks at once: ``F`` after the first match (forward extensions), ``M`` the i-th maximum period and
``S`` the i-th semi-maximum period; of M and S only items that no sequence of the block lacks are sent on, since only
those can have the prefix's support. The sums over all parts decide: a prefix is closed if no F item and no M item has
its support; growth stops (backscan) if an S item has it. Supports of all frequent patterns follow from the closed ones:
the support of a pattern is the largest among closed patterns that contain it (``recover``).

Equal sequences of a batch are merged with a weight. Items below the threshold are removed before mining; a pattern is
frequent if at least ``min_share`` of its origin's sequences and at least ``min_count`` hold it. The table of frequent
items is the only thing collected: it has at most (mean length / min_share) rows per origin. The prefixes of a level are
joined to the blocks by first item, and broadcast only if the table of them is small.

Defined results: null and blank items are skipped; sequences without items are not counted; an empty table gives no
patterns; repeated items within a sequence are kept as steps; a sequence counts once per pattern.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import clean_code, small

#: Entries a task keeps before it sends its counts on, sequences of a part, cells (sequences x length x items) of a block,
#: prefixes of a level that are sent to a block together.
FLUSH, PART_ROWS, CELLS, PREFIXES = 500_000, 250_000, 1 << 21, 2048


def from_lists(df: DataFrame, id_col: str, list_col: str, origin: str) -> DataFrame:
    """(origin, seq) of an array column, one per id that has a clean code."""
    seq = F.filter(F.transform(list_col, clean_code), lambda x: x.isNotNull())
    return _once(df.select(F.col(id_col).alias("id"), seq.alias("seq")), origin)


def from_text(df: DataFrame, id_col: str, text_col: str, origin: str) -> DataFrame:
    """(origin, seq) of a column of codes parted by white space, one per id that has a clean code."""
    seq = F.filter(F.transform(F.split(text_col, r"[\s ]+"), clean_code), lambda x: x.isNotNull())
    return _once(df.select(F.col(id_col).alias("id"), seq.alias("seq")), origin)


def _once(df: DataFrame, origin: str) -> DataFrame:
    return df.where(F.size("seq") > 0).dropDuplicates(["id"]).select(F.lit(origin).alias("origin"), "seq")


BLOCKS = "origin int, item int, part int, flat binary, lens binary, w binary"
COUNTS = "origin int, prefix string, kind string, i int, item int, n long"


def pack(own: list[tuple[bytes, int]]) -> tuple[bytes, bytes, bytes]:
    """Sequences of 32-bit codes, their lengths and weights, one after the other."""
    return b"".join([q for q, _ in own]), np.array([len(q) // 4 for q, _ in own], "<i4").tobytes(), np.array([n for _, n in own], "<i8").tobytes()


def block_counts(flat: bytes, lens: bytes, w: bytes, n_items: int, prefixes: list[tuple[int, ...]]) -> Iterator[tuple]:
    """(prefix, kind, i, item, n) of the prefixes in one block: P the support, F all counts, M and S the items that no
    sequence with the prefix lacks in its i-th (semi-)maximum period."""
    codes, size, weight = np.frombuffer(flat, "<i4"), np.frombuffer(lens, "<i4"), np.frombuffer(w, "<i8")
    n, most = len(size), int(size.max(initial=0))
    seq = np.full((n, most), -1, np.int32)
    seq[np.arange(most) < size[:, None]] = codes
    kind = np.int16 if most < 1 << 15 else np.int32
    # the next place of each item at or after a place, and its last place before one
    ahead, back = np.empty((most + 1, n, n_items), kind), np.empty((most + 1, n, n_items), kind)
    ahead[most], back[0] = most, -1
    for p in range(most - 1, -1, -1):
        ahead[p] = ahead[p + 1]
        on = np.flatnonzero(seq[:, p] >= 0)
        ahead[p, on, seq[on, p]] = p
    for p in range(most):
        back[p + 1] = back[p]
        on = np.flatnonzero(seq[:, p] >= 0)
        back[p + 1, on, seq[on, p]] = p

    tree: dict = {}
    for pre in prefixes:
        at = tree
        for x in pre:
            at = at.setdefault(x, {})
        at[None] = pre
    stack = [(tree, np.arange(n), [])]
    while stack:
        node, who, first = stack.pop()
        for x, below in node.items():
            if x is not None:
                to = ahead[first[-1] + 1 if first else 0, who, x]
                on = to < most
                if on.any():
                    stack.append((below, who[on], [f[on] for f in first] + [to[on]]))
                continue
            pre, m = below, weight[who]
            sup = int(m.sum())
            yield pre, "P", 0, -1, sup
            after = m @ (ahead[first[-1] + 1, who] < most)
            for e in np.flatnonzero(after):
                yield pre, "F", 0, int(e), int(after[e])
            starts = [np.zeros(len(who), kind)] + [f + 1 for f in first[:-1]]
            for name, end in (("M", np.full(len(who), most, kind)), ("S", first[-1] + 1)):
                for i in range(len(pre) - 1, -1, -1):
                    end = back[end, who, pre[i]]
                    for e in np.flatnonzero((ahead[starts[i], who] < end[:, None]).all(0)):
                        yield pre, name, i, int(e), sup


def closed_patterns(seqs: DataFrame, min_share: float, min_count: int) -> DataFrame:
    """(origin, pattern array<string>, support) of all closed frequent patterns of ``seqs`` (origin, seq)."""
    spark, cells, flush = seqs.sparkSession, CELLS, FLUSH
    seqs = cut(seqs)
    totals = {r["origin"]: r["n"] for r in seqs.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = {o: max(min_count, math.ceil(Fraction(str(min_share)) * n)) for o, n in totals.items()}
    schema = "origin string, pattern array<string>, support long"
    items = seqs.select("origin", F.explode(F.array_distinct("seq")).alias("item")).groupBy("origin", "item").agg(F.count(F.lit(1)).alias("n"))
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("origin")) if least else F.lit(0)
    often: dict[str, list] = defaultdict(list)
    for r in items.where(F.col("n") >= floor).orderBy("origin", "item").collect():
        often[r["origin"]].append((r["item"], r["n"]))
    if not often:
        return spark.createDataFrame([], schema)
    # origins by number; of each: item -> code, and by code the parts of its partition
    origins = sorted(often)
    at_least = F.element_at(F.array(*[F.lit(least[o]) for o in origins]), F.col("origin") + 1)
    number = spark.sparkContext.broadcast([{x: k for k, (x, _) in enumerate(often[o])} for o in origins])
    split = [[-(-n // PART_ROWS) for _, n in often[o]] for o in origins]
    name = spark.sparkContext.broadcast([[x for x, _ in often[o]] for o in origins])
    index = {o: k for k, o in enumerate(origins)}

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, seen = number.value, Counter()

        def rows() -> pd.DataFrame:
            groups: defaultdict[tuple[int, int, int], list] = defaultdict(list)
            for (o, q), n in sorted(seen.items(), key=lambda x: len(x[0][1])):  # sequences of a block are about as long
                b = np.array(q, "<i4").tobytes()
                h = zlib.crc32(b)
                for k in set(q):
                    groups[o, k, h % split[o][k]].append((b, n))
            seen.clear()
            out = []
            for (o, k, part), own in groups.items():
                at = 0
                for to in range(1, len(own) + 1):
                    if to == len(own) or (to + 1 - at) * (len(own[to][0]) // 4 + 1) * len(code[o]) > cells:
                        out.append((o, k, part, *pack(own[at:to])))
                        at = to
            return pd.DataFrame(out, columns=["origin", "item", "part", "flat", "lens", "w"])

        for f in frames:
            for o, q in zip(f["origin"].map(index), f["seq"]):
                if o == o:  # origins without frequent items have no number
                    get = code[int(o)].get
                    seen[int(o), tuple(k for x in q if (k := get(x)) is not None)] += 1
            if len(seen) > flush // 4:
                yield rows()
        yield rows()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, seen = number.value, Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["origin", "prefix", "kind", "i", "item", "n"])
            seen.clear()
            return out

        for f in frames:
            for o, flat, lens, w, prefixes in zip(f["origin"], f["flat"], f["lens"], f["w"], f["prefixes"]):
                for p, kind, i, e, n in block_counts(flat, lens, w, len(code[o]), [tuple(map(int, x.split())) for x in prefixes]):
                    seen[o, " ".join(map(str, p)), kind, i, e] += n
                if len(seen) > flush:
                    yield rows()
        yield rows()

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"origin": [origins[o] for o in f["origin"]], "pattern": [[name.value[o][int(k)] for k in p.split()] for o, p in zip(f["origin"], f["prefix"])], "support": f["sup"]})

    blocks = cut(seqs.mapInPandas(encode, BLOCKS).repartition("origin", "item", "part"))
    level = cut(spark.createDataFrame([(index[o], str(k)) for o, xs in often.items() for k in range(len(xs))], "origin int, prefix string"))  # written, so that its size is known
    n, found = sum(map(len, often.values())), []
    while n:
        first = F.split_part("prefix", F.lit(" "), F.lit(1)).cast("int")
        groups = level.groupBy("origin", first.alias("item"), F.pmod(F.xxhash64("prefix"), F.lit(-(-n // PREFIXES))).alias("g")).agg(F.collect_list("prefix").alias("prefixes"))
        counts = cut(blocks.join(small(groups), ["origin", "item"]).select("origin", "flat", "lens", "w", "prefixes").mapInPandas(count, COUNTS).groupBy("origin", "prefix", "kind", "i", "item").agg(F.sum("n").alias("n")))
        top = lambda *kinds: F.coalesce(F.max(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
        judged = counts.groupBy("origin", "prefix").agg(top("P").alias("sup"), top("F", "M").alias("wider"), top("S").alias("back"))
        found.append(judged.where("wider < sup").select("origin", "prefix", "sup"))
        grown = counts.where((F.col("kind") == "F") & (F.col("n") >= at_least)).join(judged.where("back < sup").select("origin", "prefix"), ["origin", "prefix"], "left_semi")
        level = cut(grown.select("origin", F.concat_ws(" ", "prefix", F.col("item").cast("string")).alias("prefix")))
        n = level.count()
    return reduce(DataFrame.unionByName, found).mapInPandas(decode, schema)


def recover(closed: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(origin, pattern, support) of every frequent pattern of those lengths, from the closed ones.

    Parts of closed patterns are sent on as soon as ``FLUSH`` of them are held, so that a long pattern fills no task.
    """

    flush = FLUSH

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(o, " ".join(x), s) for (o, x), s in best.items()], columns=["origin", "pattern", "support"])
            best.clear()
            return out

        for f in frames:
            for o, p, s in zip(f["origin"], f["pattern"], f["support"]):
                for n in range(shortest, min(longest, len(p)) + 1):
                    for sub in combinations(p, n):
                        if best.get((o, sub), 0) < s:
                            best[o, sub] = s
                            if len(best) >= flush:
                                yield rows()
        yield rows()

    return closed.mapInPandas(run, "origin string, pattern string, support long").groupBy("origin", "pattern").agg(F.max("support").alias("support"))
