"""Mixing sources to target shares of the tokens, by Pareto order sampling.

A source whose target is r times its tokens gives every document floor(r) whole
copies for certain.  The rest is drawn with inclusion in proportion to a document's
tokens; a document whose inclusion would reach 1 is taken for certain.  The others are
ranked by the odds of a random number divided by the odds of their inclusion, and the first ones are taken
until the source's tokens are reached: the size that is fixed is the number of tokens, since shares are of tokens.
The rank threshold is found from sums over fixed rank intervals, so no source is ever sorted in one task.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.words import TOKEN_PATTERN, VOCABULARY
from tessera.session import checkpoint_dir, table

#: Rank intervals per source; the one that holds the threshold is sorted, a 65,536th of a source.
INTERVALS = 65_536
#: More named sources than this are refused, as their totals meet on the driver.
MAX_SOURCES = 1_000
#: Size classes per doubling of the tokens; a source has at most 64 times as many.
CLASSES = 8


_encoders: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def count_tokens(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of a text (of the byte-level BPE vocabulary at the given path); 0 for NULL and empty texts."""
    path, pattern = vocabulary or VOCABULARY, TOKEN_PATTERN

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(path, pattern)
        for s in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return tokens(text)


def allocate(available: dict[str, int], shares: dict[str, float], caps: dict[str, int]) -> dict[str, float]:
    """Tokens to take from each source.

    The total is all available tokens of the named sources.  What a source
    can't give within its cap goes to the others in proportion to their
    shares, again and again until the total is met or every source is at its cap.
    """
    total = float(sum(available.get(s, 0) for s in shares))
    room = {s: float(available.get(s, 0)) * max(caps[s], 0) for s in shares}
    take = {s: 0.0 for s in shares}
    open_ = {s for s in shares if room[s] > 0 and shares[s] > 0}
    left = total
    while open_ and left > 1e-6:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if take[s] + left * shares[s] / weight >= room[s]}
        if not full:
            for s in open_:
                take[s] += left * shares[s] / weight
            break
        for s in full:
            left -= room[s] - take[s]
            take[s] = room[s]
        open_ -= full
    return take


@dataclass(frozen=True)
class Draw:
    """What a source gives: certain whole copies of every document, and the tokens to draw beyond them.

    Of the drawn ones, documents of size class ``sure`` and above are taken for certain; the inclusion of the others is ``rate`` times their weight.
    """

    certain: int = 0
    tokens: float = 0.0
    sure: int = 1 << 30
    rate: float = 0.0


#: Of a source and a size class: class, tokens, sum of weight * tokens, greatest weight.
Sizes = list[tuple[int, int, float, float]]


def size_class(weight: Column) -> Column:
    """The class of a weight: CLASSES per doubling."""
    return F.floor(F.log2(F.greatest(weight, F.lit(1e-9))) * CLASSES).cast("int")


def sizes_of(docs: DataFrame, sources: list[str]) -> dict[str, Sizes]:
    """Totals of each named source by size class, in one pass; at most MAX_SOURCES times 64 * CLASSES rows."""
    known = docs.where(F.col("source").isin(sources) & (F.col("tokens") > 0) & (F.col("weight") > 0))
    summed = known.groupBy("source", size_class(F.col("weight")).alias("class")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("weight") * F.col("tokens")).alias("mass"), F.max("weight").alias("most"))
    out: dict[str, Sizes] = {}
    for r in summed.collect():
        out.setdefault(r["source"], []).append((r["class"], r["tokens"], r["mass"], r["most"]))
    return {k: sorted(v) for k, v in out.items()}


def draw_of(sizes: Sizes, take: float, cap: int) -> Draw:
    """How ``take`` tokens come from a source of these sizes: whole copies, then classes whose inclusion would reach 1, then a rate."""
    whole = sum(n for _, n, _, _ in sizes)
    if not whole:
        return Draw()
    certain = min(math.floor(take / whole + 1e-12), cap)
    left = max(0.0, take - certain * whole) if certain < cap else 0.0
    drawn, sure = left, 1 << 30
    for k in range(len(sizes), 0, -1):
        mass = sum(m for _, _, m, _ in sizes[:k])
        rate = left / mass if mass else 0.0
        if rate * sizes[k - 1][3] < 1 or left <= 0:
            return Draw(certain, drawn, sure, max(0.0, rate))
        sure, left = sizes[k - 1][0], left - sizes[k - 1][1]
    return Draw(certain, drawn, sure, 0.0)


def mix(docs: DataFrame, plan: dict[str, Draw], seed: int = 0) -> DataFrame:
    """Copies of each document.

    ``docs`` has id, source, tokens and weight (inclusion is in proportion to
    it within a source).  ``plan`` gives each source what ``draw_of`` tells.
    Documents of other sources (a NULL one included) and those without tokens get 0 copies;
    an empty table gives no rows; columns other than the four are ignored.  Every source gets its tokens up to half of the last document taken.
    """
    spark = docs.sparkSession
    steps = F.broadcast(spark.createDataFrame([(s, d.certain, d.tokens, d.sure, d.rate) for s, d in plan.items()], "source string, certain int, draw double, sure int, rate double"))  # at most MAX_SOURCES rows
    known = docs.select("id", "source", "tokens", "weight").join(steps, "source", "left")
    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    p = F.least(F.when(size_class(F.col("weight")) >= F.col("sure"), 1.0).otherwise(F.col("rate") * F.col("weight")), F.lit(1 - 1e-12))
    odds = (u / (1 - u)) * ((1 - p) / p)
    drawn = (F.col("draw") > 0) & (F.col("tokens") > 0) & (F.col("weight") > 0) & (p > 0)
    ranked = known.withColumn("at", F.when(drawn, odds / (1 + odds))).withColumn("interval", F.floor(F.col("at") * INTERVALS))
    sums = ranked.where("at IS NOT NULL").groupBy("source", "interval", "draw").agg(F.sum("tokens").alias("sum"))
    run = F.sum("sum").over(Window.partitionBy("source").orderBy("interval"))  # at most INTERVALS rows a source
    edge = sums.withColumn("before", run - F.col("sum")).where(F.col("before") < F.col("draw")).groupBy("source").agg(F.max("interval").alias("interval"), F.max("before").alias("before"))
    # in the threshold's interval: whole documents in rank order, the last one if that comes nearer to the target
    close = ranked.join(F.broadcast(edge), ["source", "interval"])  # one row per source
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("at", "id"))
    inside = close.withColumn("upto", upto).where(F.col("upto") - F.col("tokens") / 2 <= F.col("draw"))
    last = inside.groupBy("source").agg(F.max(F.struct("at", "id")).alias("last"))
    ends = F.broadcast(edge.select("source", "interval").join(last, "source", "left").select("source", F.col("interval").alias("edge"), "last"))  # one row per source
    more = F.when((F.col("interval") < F.col("edge")) | (F.struct("at", "id") <= F.col("last")), 1).otherwise(0)
    copies = F.when(F.col("tokens") > 0, F.coalesce("certain", F.lit(0)) + more).otherwise(0).cast("int")
    return ranked.join(ends, "source", "left").select("id", "source", "tokens", copies.alias("copies"))


def _targets(spark: SparkSession, sf_dir: str) -> dict[str, tuple[float, int]]:
    t = table(spark, sf_dir, "mix_targets").select(F.lower(F.trim("source_name")).alias("s"), "target_share", "max_repeats").where("s <> ''")
    rows = t.groupBy("s").agg(F.max("target_share"), F.max("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} named sources")
    return {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in rows}


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source (trimmed, lower-cased), tokens and weight (the tokens) of every document; kept, as counting is the costly part."""
    checkpoint_dir(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("source"), "text")
    return d.select("id", "source", count_tokens(F.col("text")).alias("tokens")).withColumn("weight", F.col("tokens").cast("double")).checkpoint()


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, tuple[float, int]], dict[str, int], dict[str, float]]:
    targets, docs = _targets(spark, sf_dir), sized_documents(spark, sf_dir)
    sizes = sizes_of(docs, list(targets))
    available = {s: sum(n for _, n, _, _ in v) for s, v in sizes.items()}
    take = allocate(available, {s: a for s, (a, _) in targets.items()}, {s: c for s, (_, c) in targets.items()})
    return mix(docs, {s: draw_of(v, take[s], targets[s][1]) for s, v in sizes.items()}), targets, available, take


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return _mixed(spark, sf_dir)[0].select(F.col("id").alias("doc_id"), F.col("source").alias("source_name"), "tokens", "copies")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every named source, also of those without documents; planned_tokens is the target within the caps."""
    mixed, targets, available, take = _mixed(spark, sf_dir)
    named = spark.createDataFrame([(s, a, c, int(available.get(s, 0)), float(take.get(s, 0.0))) for s, (a, c) in targets.items()], "source_name string, target_share double, max_repeats int, available_tokens long, planned_tokens double")
    taken = mixed.where("copies > 0").groupBy(F.col("source").alias("source_name")).agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("most_copies"))
    joined = F.broadcast(named).join(taken, "source_name", "left").fillna(0)
    everything = Window.partitionBy(F.lit(0))  # at most MAX_SOURCES rows
    shares = joined.withColumn("total_tokens", F.sum("taken_tokens").over(everything)).withColumn("actual_share", F.col("taken_tokens") / F.col("total_tokens"))
    return shares.withColumn("deviation", F.col("actual_share") - F.col("target_share"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLE: dict[str, str] = {}
