"""Exclusive quantiles: rank p * (n + 1), interpolated; outside the ranks the extremes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Value intervals of a group; only those that hold a wanted rank are sorted.
INTERVALS = 128


def exclusive_quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles p50, p95 ... of each group, exactly as ``statistics.quantiles(method="exclusive")`` interpolates.

    Values are first counted, NULLs left out; a single value is every quantile.  A sketch of each group's values gives interval
    bounds, exact counts per interval tell which of them hold the wanted ranks, and only those are
    sorted, each by itself: no task holds a whole group, whatever its size.  Without ``by`` the table is one group; an empty one gives no rows.
    """
    keys = [f"__k{i}" for i in range(max(1, len(by)))]
    named = [F.col(b).alias(k) for k, b in zip(keys, by)] or [F.lit(0).alias(keys[0])]
    counted = df.where(F.col(value).isNotNull()).groupBy(*named, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    bounds = counted.groupBy(*keys).agg(F.percentile_approx("v", [i / INTERVALS for i in range(1, INTERVALS)], 1000).alias("bounds")).withColumnsRenamed({k: f"b{k}" for k in keys})
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys]  # noqa: E731  a NULL is a group of its own
    placed = counted.join(bounds, same("b")).select(*keys, "v", "c", F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("i"))
    sums = placed.groupBy(*keys, "i").agg(F.sum("c").alias("n"))
    whole = Window.partitionBy(*keys)  # at most INTERVALS rows a group
    prefix = sums.withColumn("upto", F.sum("n").over(whole.orderBy("i"))).withColumn("all", F.sum("n").over(whole))
    rank = lambda p: F.lit(float(p)) * (F.col("all") + 1)
    low = lambda p: F.least(F.greatest(F.floor(rank(p)), F.lit(1)), F.col("all"))
    high = lambda p: F.least(low(p) + 1, F.col("all"))
    share = lambda p: F.least(F.greatest(rank(p) - low(p), F.lit(0.0)), F.lit(1.0))
    ranks = F.array_distinct(F.array(*[r(p) for p in at for r in (low, high)]))
    held = prefix.where(F.exists(ranks, lambda r: (r > F.col("upto") - F.col("n")) & (r <= F.col("upto")))).select(*[F.col(k).alias(f"h{k}") for k in keys], F.col("i").alias("hi_"), (F.col("upto") - F.col("n")).alias("before"), "all")
    near = placed.join(held, [*same("h"), F.col("i") == F.col("hi_")])
    last = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("v"))
    ranked = near.withColumn("last", last).withColumn("first", F.col("last") - F.col("c") + 1)
    pick = lambda r: F.max(F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("v")))
    columns = [(pick(low(p)) + F.max(share(p)) * (pick(high(p)) - pick(low(p)))).alias(f"p{round(p * 100):02d}") for p in at]
    return ranked.groupBy(*keys).agg(*columns).select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *[f"p{round(p * 100):02d}" for p in at])
