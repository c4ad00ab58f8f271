"""References to records that do not exist, or not at that time.

Ids become integers: 128 bits in two halves, order and neighbours kept for GUIDs and decimal numbers.  The sorted keys of the
targets are compressed into contiguous runs.  Each reference is matched as-of with the run that starts at or before
its key; a key beyond that run's end has no target.  References that have one are then tested the same way against
the runs of microseconds at which it existed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: A bucket of decimal ids holds as many neighbouring numbers as two to this power.
BLOCK = 16
KEY = ("space", "hi", "lo")


def integer_key(id_: Column, target: Column | None = None) -> list[Column]:
    """space, hi and lo of a canonical id: the 128 bits of a GUID, a decimal number by itself, the MD5 of any other id; NULL for NULL.

    ``target`` (a small integer) keeps the ids of several targets apart.
    """
    guid, number = id_.rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"), id_.rlike("^(0|[1-9][0-9]{0,17})$")
    digits = F.when(guid, F.replace(id_, F.lit("-"), F.lit(""))).otherwise(F.md5(id_))
    word = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    half = lambda at: F.shiftleft(word(at), 32).bitwiseOR(word(at + 8))
    value = F.when(number, id_.cast("long"))
    kind = F.when(number, 1).when(guid, 0).otherwise(2)
    space = F.when(id_.isNotNull(), kind + 3 * (target if target is not None else F.lit(0))).cast("int")
    hi = F.when(number, F.shiftright(value, BLOCK)).otherwise(half(1))
    lo = F.when(number, value.bitwiseAND((1 << BLOCK) - 1)).otherwise(half(17))
    return [space.alias("space"), hi.alias("hi"), lo.alias("lo")]


def _bucket(bits: int) -> Column:
    """Where a key's run is looked for: the first bits of a GUID or MD5, the block of a decimal number; runs never leave a bucket."""
    first = F.shiftrightunsigned("hi", 64 - bits) if bits else F.lit(0).cast("long")
    return F.when(F.col("space") % 3 == 1, F.col("hi")).otherwise(first)


def key_runs(keys: DataFrame, bits: int) -> DataFrame:
    """Contiguous runs of the integer keys: space, bucket, first, last and next (the first key of the bucket's next run, NULL for the last).

    Keys of equal leading bits meet in one window, which sorts the targets' distinct keys only, never references.
    """
    w = Window.partitionBy("space", "bucket").orderBy("hi", "lo")
    sorted_ = keys.select(*KEY).distinct().withColumn("bucket", _bucket(bits))
    neighbour = (F.lag("hi").over(w) == F.col("hi")) & (F.lag("lo").over(w) == F.col("lo") - 1) & (F.col("lo") > LOWEST)
    numbered = sorted_.withColumn("starts", F.when(neighbour, 0).otherwise(1)).withColumn("run", F.sum("starts").over(w))
    runs = numbered.groupBy("space", "bucket", "run").agg(F.min(F.struct("hi", "lo")).alias("first"), F.max(F.struct("hi", "lo")).alias("last"))
    return runs.withColumn("next", F.lead("first").over(Window.partitionBy("space", "bucket").orderBy("first"))).drop("run")


def time_runs(lives: DataFrame) -> DataFrame:
    """Contiguous runs of the microseconds (key, from, to) at which each key exists: the key, from, to, next_from, too_early.

    Overlapping and adjacent intervals become one; an empty interval (to < from)
    marks that the key was known from then on.  Each key also gets the run that
    holds nothing before its first microsecond, so every instant matches exactly one run of a known key.
    """
    w = Window.partitionBy(*KEY).orderBy("from", "to")
    reach = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # to < HIGHEST in the sum: an open run has no instant after it
    starts = F.when(reach.isNull() | ((reach < HIGHEST) & (F.col("from") > reach + 1)), 1).otherwise(0)
    island = lives.distinct().withColumn("starts", starts).withColumn("island", F.sum("starts").over(w))
    runs = island.groupBy(*KEY, "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    following = Window.partitionBy(*KEY).orderBy("from")
    linked = runs.withColumn("next_from", F.coalesce(F.lead("from").over(following), F.lit(HIGHEST))).withColumn("first", F.row_number().over(following) == 1)
    own = F.struct("from", "to", "next_from", F.lit(False).alias("too_early"))
    lowest = F.lit(LOWEST).cast("long")
    before = F.struct(lowest.alias("from"), lowest.alias("to"), F.col("from").alias("next_from"), F.lit(True).alias("too_early"))
    # exploded rather than united, so the runs of a key stay in one partition
    return linked.select(*KEY, F.inline(F.when(F.col("first"), F.array(before, own)).otherwise(F.array(own))))


def lifetimes(parents: DataFrame, id_: Column, first: Column, gone: Column, target: int = 0) -> DataFrame:
    """The integer key and the interval of life of each row of a dimension; a NULL start counts as known from the beginning but never alive."""
    lo = F.coalesce(F.unix_micros(first), F.lit(LOWEST + 1))
    hi = F.when(first.isNull(), F.lit(LOWEST + 1)).otherwise(F.coalesce(F.unix_micros(gone) - 1, F.lit(HIGHEST)))
    return parents.where(id_.isNotNull()).select(*integer_key(id_, F.lit(target)), lo.alias("from"), F.greatest(hi, lo - 1).alias("to"))


def orphan_references(refs: DataFrame, parents: DataFrame, target: Column | None = None) -> DataFrame:
    """``refs`` (ref_id, ref_at and any other columns) that found no living target, with orphan_kind.

    ``missing``: no target has the id; ``late``: every target begins later;
    ``deleted``: a target began before and was gone.  A NULL ref_id is no
    reference; with NULL ref_at only ``missing`` is possible.  ``parents`` is as from ``lifetimes``, of one target or several
    (``target`` then tells which one a reference means); when it is empty, every reference is missing.  Other columns of
    ``refs`` are carried along, whatever their names; only one called orphan_kind is replaced.
    Both joins pick broadcast or shuffle by the measured size of the runs;
    adaptive execution splits a hot id on the reference side.
    """
    bits = min(40, max(1, math.ceil(math.log2(parents.count() + 2))))  # about one target a bucket
    carried = [c for c in refs.columns if c != "orphan_kind"]
    row = refs.where(F.col("ref_id").isNotNull()).select(F.struct(*carried).alias("row"), "ref_at", *integer_key(F.col("ref_id"), target))
    known = row.withColumn("bucket", _bucket(bits)).withColumn("key", F.struct("hi", "lo"))
    runs = key_runs(parents, bits).withColumnsRenamed({"space": "run_space", "bucket": "run_bucket"})
    as_of = (F.col("space") == F.col("run_space")) & (F.col("bucket") == F.col("run_bucket")) & (F.col("first") <= F.col("key")) & (F.col("next").isNull() | (F.col("key") < F.col("next")))
    placed = known.join(runs, as_of, "left").withColumn("exists", F.coalesce(F.col("key") <= F.col("last"), F.lit(False))).withColumn("at", F.coalesce(F.unix_micros("ref_at"), F.lit(LOWEST)))
    lives = time_runs(parents).withColumnsRenamed({c: f"of_{c}" for c in KEY})
    # a key without a target has no lives either
    then = F.col("exists") & (F.col("hi") == F.col("of_hi")) & (F.col("lo") == F.col("of_lo")) & (F.col("space") == F.col("of_space"))
    then &= (F.col("from") <= F.col("at")) & ((F.col("at") < F.col("next_from")) | (F.col("at") == HIGHEST))
    kind = F.when(~F.col("exists"), "missing").when(F.col("ref_at").isNull(), None).when(F.col("too_early"), "late").when(F.col("at") > F.col("to"), "deleted")
    return placed.join(lives, then, "left").withColumn("kind", kind).where("kind IS NOT NULL").select("row.*", F.col("kind").alias("orphan_kind"))
