"""The N best rows of every group, with a hot-cold split.

Exact group counts tell heavy groups from light ones before anything is shuffled by
group.  Light groups rank in an ordinary window.  A heavy group is dealt to as many
salted slices as its count asks for; the slices are spread by ranges of (group, salt)
and sorted, each keeps its first N, and only those meet in a last window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_id
from tessera.session import table


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def _latest(df: DataFrame, group: str, item: Sequence[str], version: str) -> DataFrame:
    """The latest version of every item; of equal versions the row with the largest remaining values."""
    rest = [c for c in df.columns if c not in (group, *item, version)]
    (best,) = _fresh(df, "best")
    newest = F.max(F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate([version, *rest])])).alias(best)
    return df.groupBy(group, *item).agg(newest).select(group, *item, *[F.col(best)[f"f{i}"].alias(c) for i, c in enumerate([version, *rest])])


def _ranked(df: DataFrame, rank: str, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


#: A group is heavy from a ``MOST_HOT``-th of all rows on, so there are never more heavy groups than this and their list may be broadcast.
MOST_HOT = 10_000
#: Groups of at most this many rows per wanted row are light whatever their share is: cutting them up saves nothing.
SMALLEST = 20


def hot_groups(rows: DataFrame, group: str, n: int, slice_rows: int) -> DataFrame:
    """The heavy groups (fewer than MOST_HOT) and the number of slices of each, from exact counts."""
    counted = rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("count"))
    share = counted.agg((F.sum("count") / MOST_HOT).alias("share")).scalar()
    hot = counted.where((F.col("count") > SMALLEST * n) & (F.col("count") > share))
    return hot.select("group", F.greatest(F.lit(2), F.least(F.lit(100_000), F.ceil(F.col("count") / slice_rows))).cast("int").alias("slices"))


def top_n_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int, item: Sequence[str] | None = None, version: str | None = None, slice_rows: int = 100_000) -> DataFrame:
    """The first ``n`` rows of every group by ``order``, with rank_no from 1.

    Ties left by ``order`` are broken by the hash of all columns, so rows that are equal in every column are all that can
    change places.  With ``item`` and ``version`` only the latest version of each item takes part (of equal ones the row
    with the largest remaining values; a NULL version is the oldest).  Rows with a NULL group don't take part; groups smaller than
    ``n`` come whole; an empty table gives no rows.  Other columns are carried along, whatever their names; only one called rank_no
    is replaced.  ``slice_rows`` is the number of rows of a heavy group that one slice gets (two slices at least); it changes the plan, never the result.
    """
    df = df.drop("rank_no")
    hot_group, slices, salt, rank = _fresh(df, "hot_group", "slices", "salt", "rank")
    rows = df.where(F.col(group).isNotNull())
    # counts are of rows before versions are dropped: an upper bound of the group's size
    hot = F.broadcast(hot_groups(rows, group, n, slice_rows).withColumnsRenamed({"group": hot_group, "slices": slices}))  # fewer than MOST_HOT rows
    light = rows.join(hot, F.col(group) == F.col(hot_group), "left_anti").repartition(group)
    hard = rows.join(hot, F.col(group) == F.col(hot_group)).drop(hot_group)
    if version:
        # light rows are in place by group; those of a heavy group meet by item
        light = _latest(light, group, item, version)
        hard = _latest(hard, group, [*item, slices], version)
    order = [*order, F.xxhash64(*[c for c in rows.columns if c != group])] if len(rows.columns) > 1 else list(order)
    # ranges of (group, salt) keep a slice in one task, so ranking it needs no further shuffle
    spread = hard.withColumn(salt, F.pmod(F.xxhash64(*[c for c in rows.columns if c != group], F.lit(1)), F.col(slices))).drop(slices).repartitionByRange(F.col(group), F.col(salt))
    firsts = _ranked(spread, rank, (group, salt), order, n).drop(rank, salt)
    return _ranked(light, rank, (group,), order, n).unionByName(_ranked(firsts, rank, (group,), order, n)).withColumnRenamed(rank, "rank_no").select(*df.columns, "rank_no")


def _scored(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    a = table(spark, sf_dir, "ai_chunks")
    # least and greatest skip NULLs, so the limits apply only to a known score
    limited = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0)), F.lit(100))).alias(c)
    taking = a.where(F.col("ai_error").isNull() & F.col("exfiltration_risk_score").isNotNull())
    return taking.select(canonical_id(F.col("notebook_id")).alias("notebook_id"), "chunk_index", "assessed_at", limited("exfiltration_risk_score"), limited("external_resource_access_score"), *more)


def _top3(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    order = [F.desc("exfiltration_risk_score"), F.desc_nulls_last("external_resource_access_score"), F.asc("chunk_index")]
    return top_n_per_group(_scored(spark, sf_dir, *more), "notebook_id", order, 3, item=("chunk_index",), version="assessed_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three riskiest chunks of every notebook."""
    return _top3(spark, sf_dir).select("notebook_id", "rank_no", "chunk_index")


def p5_top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p5_found`` with scores and rationales."""
    return _top3(spark, sf_dir, "rationale").select("notebook_id", "rank_no", "chunk_index", "exfiltration_risk_score", "external_resource_access_score", "rationale")


QUERIES = {"p5_found": p5_found, "p5_top_chunks": p5_top_chunks}

_ID = "lower(regexp_replace(notebook_id, '[^0-9A-Fa-f]', '', 'g'))"
_SQL = f"""
WITH scored AS (
  SELECT CASE WHEN length({_ID}) = 32 THEN regexp_replace({_ID}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')
              WHEN trim(notebook_id) <> '' THEN lower(trim(notebook_id)) END AS notebook_id,
         chunk_index, assessed_at, least(greatest(exfiltration_risk_score, 0), 100) AS exfiltration_risk_score,
         CASE WHEN external_resource_access_score IS NOT NULL THEN least(greatest(external_resource_access_score, 0), 100) END AS external_resource_access_score, rationale
  FROM ai_chunks WHERE ai_error IS NULL AND exfiltration_risk_score IS NOT NULL),
held AS (SELECT *, row_number() OVER (PARTITION BY notebook_id, chunk_index ORDER BY assessed_at DESC, exfiltration_risk_score DESC, external_resource_access_score DESC NULLS LAST, rationale DESC NULLS LAST) AS v
         FROM scored WHERE notebook_id IS NOT NULL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY notebook_id ORDER BY exfiltration_risk_score DESC, external_resource_access_score DESC NULLS LAST, chunk_index) AS INTEGER) AS rank_no
           FROM held WHERE v = 1)
"""
ORACLE = {
    "p5_found": _SQL + "SELECT notebook_id, rank_no, chunk_index FROM ranked WHERE rank_no <= 3",
    "p5_top_chunks": _SQL + "SELECT notebook_id, rank_no, chunk_index, exfiltration_risk_score, external_resource_access_score, rationale FROM ranked WHERE rank_no <= 3",
}
