"""Mixing sources to target weights, in tokens, by Pfair scheduling of blocks.

Sizes: every document is counted in tokens of a public tokenizer. Quotas: sources without tokens are left out and the
weights of the others scaled to 1; the mixture is the largest one in which every source keeps its weight while no
document is used more than ``max_repeat`` times (or ``total`` tokens, if less is asked for; sources that are too small
for their part of ``total`` then give all they may).

Order: within a source documents follow a hash of their id, pass after pass; a running sum of tokens, taken in two steps
over buckets of bounded size so that no task holds a source, cuts the pass into blocks of ``BLOCK`` tokens (a document
belongs to the block it begins in). Weights are shares in units of 1 / ``RESOLUTION``. A schedule of one period, with as
many slots as the weights have units (so at most ``RESOLUTION``), is made on the driver: block k of a source with weight w
is released at slot floor((k-1)/w) and due at ceil(k/w), and the earliest deadline among the released blocks gets each
slot. At the end of a period every source has exactly its share, so the schedule repeats: block k has the slot of its
remainder, moved by the period's length for each period before. Any number of blocks is thus placed by a join with a small
table, and every source stays within one block of its ideal share at any slot until it has run out; a source that runs out
leaves its slots empty. In tokens the distance is at most a block and the longest document more; the report gives it as
measured.

Defined results: sources are compared trimmed, in lower case, with ``_`` for blanks and hyphens; null sources and those
that the target does not name are not used; empty texts have no tokens and are not used; document ids are unique; an
empty corpus gives an empty mixture and a report of zeros; extra columns are not read. The vocabulary is read where the
job starts and sent to the tasks.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import gcd
from pathlib import Path

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import running
from ..session import cut

#: Path of the tokenizer's vocabulary (ranks of byte pairs) and, fixed with it, its pattern of pieces.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block, units of a share, rows of a bucket.
BLOCK, RESOLUTION, BUCKET_ROWS = 2_048, 10_000, 50_000
_ENCODERS: dict = {}


def encoder(vocabulary: bytes | None = None):
    """The tokenizer of a vocabulary file's content, made once per worker process."""
    vocabulary = Path(TOKENIZER).read_bytes() if vocabulary is None else vocabulary
    key = xxhash.xxh64_intdigest(vocabulary)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def clean_source(c: Column) -> Column:
    x = F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"[\s_-]+", "_"))
    return F.when(x != "", x)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER) -> DataFrame:
    """(id, source, n_tokens) of the documents with a source and at least one token."""
    src = docs.select(F.col(id_col).alias("id"), clean_source(F.col(source)).alias("source"), F.col(text).alias("t")).where("source is not null and t <> ''")

    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # a tokenizer's vocabulary, of a fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary.value)
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "source": f["source"], "n_tokens": [len(enc.encode_ordinary(t)) for t in f["t"]]})

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, source string, n_tokens long")


def _exact(x: float | Fraction) -> Fraction:
    return x if isinstance(x, Fraction) else Fraction(str(x))


def quotas(targets: list[dict], have: dict[str, int], total: int | None = None) -> dict[str, Fraction]:
    """Tokens each source gives. ``targets``: source, target_share, max_repeat; ``have``: tokens by source."""
    live = [t for t in targets if t["target_share"] and have.get(t["source"]) and t["max_repeat"]]
    weight = sum(_exact(t["target_share"]) for t in live)
    out = {t["source"]: Fraction(0) for t in targets}
    if not live:
        return out
    w = {t["source"]: _exact(t["target_share"]) / weight for t in live}
    cap = {t["source"]: t["max_repeat"] * have[t["source"]] for t in live}
    most = min(Fraction(cap[s]) / w[s] for s in w)
    size = most if total is None else total
    return out | {s: min(Fraction(cap[s]), w[s] * size) for s in w}


def schedule(blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot): earliest deadline first over the blocks' windows."""
    total = sum(blocks.values())
    coming = [(0, -(-total // n), s, 1) for s, n in sorted(blocks.items()) if n]  # release, deadline, source, k
    heapq.heapify(coming)
    ready: list = []
    out = []
    for slot in range(total):
        while coming and coming[0][0] <= slot:
            r, due, s, k = heapq.heappop(coming)
            heapq.heappush(ready, (due, s, k))
        due, s, k = heapq.heappop(ready)
        out.append((s, k - 1, slot))
        n = blocks[s]
        if k < n:
            heapq.heappush(coming, (k * total // n, -(-(k + 1) * total // n), s, k + 1))
    return out


def max_lag(order: list[tuple[str, int, int]], blocks: dict[str, int]) -> dict[str, float]:
    """Largest distance, in blocks, between what a source has had and its ideal share, at any slot."""
    total, got, worst = sum(blocks.values()), dict.fromkeys(blocks, 0), dict.fromkeys(blocks, Fraction(0))
    for s, _, slot in order:
        worst[s] = max(worst[s], abs(Fraction(blocks[s] * slot, total) - got[s]))  # before it runs it is most behind
        got[s] += 1
        worst[s] = max(worst[s], abs(Fraction(blocks[s] * (slot + 1), total) - got[s]))  # after it has run, most ahead
    return {s: float(x) for s, x in worst.items()}


def offsets(sized: DataFrame, n_docs: int, seed: int = 0) -> DataFrame:
    """``sized`` with ``start``: tokens of the documents of the source before this one, in the order of a hash."""
    h = F.xxhash64(F.col("id"), F.lit(seed))
    buckets = max(1, -(-n_docs // BUCKET_ROWS))
    # the leading bits of the hash, so that buckets follow its order
    b = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * buckets).cast("long")
    rows = sized.withColumn("h", h).withColumn("bucket", b)
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("m"))
    before = sums.withColumn("base", F.coalesce(F.sum("m").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(before, ["source", "bucket"]).select("source", "id", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))


def token_lag(mixture: DataFrame, share: DataFrame, last: int) -> DataFrame:
    """(source, lag): the largest distance, in tokens, between what a source has given and its share of all tokens, at any slot up
    to ``last``. ``share``: source, w. It is met where a source is about to give a block or has just given it."""
    blocks = mixture.where(F.col("slot") <= last).groupBy("slot", "source").agg(F.sum("n_tokens").alias("m"))
    run = running(running(blocks, [], "slot", "m", "all"), ["source"], "slot", "m", "own").join(F.broadcast(share), "source")  # a row per source
    after = F.abs(F.col("own") - F.col("w") * F.col("all"))
    before = F.abs(F.col("own") - F.col("m") - F.col("w") * (F.col("all") - F.col("m")))
    return run.groupBy("source").agg(F.max(F.greatest(after, before)).alias("lag"))


def mix(docs: DataFrame, target: DataFrame, total: int | None = None, id_col: str = "doc_id", tokenizer: str = TOKENIZER, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    Mixture: (slot, source, doc_id, use_no, n_tokens, block_start), a row per use of a document, to be read in the order
    of slot and block_start. Report: a row per source of the target with the shares reached and the caps kept.
    """
    spark = docs.sparkSession
    sized = cut(count_tokens(docs, id_col=id_col, path=tokenizer))
    want = [r.asDict() for r in target.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeat").where("source is not null").collect()]  # the target names the sources; it is the only list collected with the totals of these sources
    units = {t["source"]: round((t["target_share"] or 0) * RESOLUTION) for t in want}
    names = [t["source"] for t in want]
    have = {r["source"]: r for r in sized.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    quota = quotas([t | {"target_share": Fraction(units[t["source"]], RESOLUTION)} for t in want], {s: r["tokens"] for s, r in have.items()}, total)
    repeat = {t["source"]: t["max_repeat"] for t in want}
    live = {s: units[s] for s, q in quota.items() if q}
    whole = gcd(*live.values()) or 1
    live = {s: n // whole for s, n in live.items()}
    period = sum(live.values())
    order = schedule(live)
    lag = max_lag(order, live)
    plan = [(s, float(quota[s]), have[s]["tokens"], repeat[s], n) for s, n in live.items()]
    rows = offsets(sized.where(F.col("source").isin(list(live))), max([r["n"] for r in have.values()], default=0), seed)
    uses = (
        rows.join(F.broadcast(spark.createDataFrame(plan, "source string, quota double, pass_tokens long, max_repeat int, units int")), "source")
        .withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("max_repeat"))))
        .withColumn("at", (F.col("use_no") - 1) * F.col("pass_tokens") + F.col("start"))
        .where(F.col("at") + F.col("n_tokens") / 2 <= F.col("quota"))
        .withColumn("block", F.floor(F.col("at") / BLOCK))
    )
    slots = F.broadcast(spark.createDataFrame(order, "source string, nth int, slot0 int"))  # a period: at most RESOLUTION rows
    placed = uses.withColumn("nth", (F.col("block") % F.col("units")).cast("int")).join(slots, ["source", "nth"]).withColumn("slot", F.floor(F.col("block") / F.col("units")) * period + F.col("slot0"))
    mixture = cut(placed.select("slot", "source", F.col("id").alias(id_col), "use_no", "n_tokens", (F.col("at") - F.col("block") * BLOCK).alias("block_start")))
    used = {r["source"]: r for r in mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("slot").alias("last"), F.max("use_no").alias("uses"), F.count(F.lit(1)).alias("n")).collect()}
    size = sum(r["tokens"] for r in used.values())
    weight = spark.createDataFrame([(s, n / period) for s, n in live.items()], "source string, w double")
    tokens_off = token_lag(mixture, weight, min([r["last"] for r in used.values()], default=-1))
    lines = []
    for t in want:
        s, u, h = t["source"], used.get(t["source"]), have.get(t["source"])
        lines.append((s, t["target_share"], live.get(s, 0) / period if period else 0.0, u["tokens"] / size if u else 0.0, h["n"] if h else 0, h["tokens"] if h else 0, t["max_repeat"], u["uses"] if u else 0, u["n"] if u else 0, u["tokens"] if u else 0, round(lag.get(s, 0.0), 6), size, BLOCK))
    report = spark.createDataFrame(lines, "source string, target_share double, share_of_present double, reached_share double, n_docs long, tokens_available long, max_repeat int, most_uses int, n_uses long, tokens_used long, max_lag_blocks double, mixture_tokens long, block_tokens long")
    return mixture, report.join(F.broadcast(tokens_off), "source", "left").withColumn("max_lag_tokens", F.round(F.coalesce("lag", F.lit(0.0)), 1)).drop("lag")  # a row per source
