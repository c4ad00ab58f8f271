"""Changes between consecutive full snapshots.

Every record becomes a compact pair of 16 key bytes and one 64-bit hash of its
values.  The pairs are spread over hash buckets, as many as the table's rows ask for, and each bucket compares the
sorted key arrays of one snapshot with those of the one before by
``searchsorted``.  Only the keys that differ go back for their full values.
A key that is a GUID is its own 16 bytes, so its spelling needs no way back; any other key travels beside its MD5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

#: More labels than this are refused, as they are listed on the driver.
MAX_SNAPSHOTS = 100_000
KIND = {0: "added", 1: "removed", 2: "changed"}
#: Rows of the table for one bucket: what a task holds of two snapshots at once is at most this many pairs, however they fall on the labels.
BUCKET_ROWS = 500_000


def _bytes16(s: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(s), dtype="V16") if len(s) else np.empty(0, "V16")


def _order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16-byte keys as sortable big-endian pairs packed in a fixed-width byte string, and their order."""
    hi_lo = keys.view(">u8").reshape(-1, 2)
    return hi_lo, np.lexsort((hi_lo[:, 1], hi_lo[:, 0]))


def _packed(hi_lo: np.ndarray) -> np.ndarray:
    out = np.empty(len(hi_lo), dtype=[("hi", "u8"), ("lo", "u8")])
    out["hi"], out["lo"] = hi_lo[:, 0], hi_lo[:, 1]
    return out


def _find(sorted_keys: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Position of each probe in the sorted keys, or -1."""
    if not len(sorted_keys) or not len(probe):
        return np.full(len(probe), -1)
    first = np.searchsorted(sorted_keys["hi"], probe["hi"], "left")
    last = np.searchsorted(sorted_keys["hi"], probe["hi"], "right")
    at = np.where(first < last, first, 0)
    hit = (first < last) & (sorted_keys[at]["lo"] == probe["lo"])
    for i in np.flatnonzero((last - first > 1) & ~hit):  # equal leading halves are rare: look among them
        j = first[i] + np.searchsorted(sorted_keys["lo"][first[i] : last[i]], probe["lo"][i])
        if j < last[i] and sorted_keys["lo"][j] == probe["lo"][i]:
            at[i], hit[i] = j, True
    return np.where(hit, at, -1)


def diff_arrays(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and kinds (0 added, 1 removed, 2 changed) of two sorted (keys, row hashes) pairs."""
    there = _find(old[0], new[0])
    gone = _find(new[0], old[0]) < 0
    added = there < 0
    changed = ~added
    if len(old[0]):
        changed &= old[1][np.maximum(there, 0)] != new[1]
    keys = np.concatenate([new[0][added], old[0][gone], new[0][changed]])
    kinds = np.concatenate([np.zeros(added.sum(), "i4"), np.ones(gone.sum(), "i4"), np.full(changed.sum(), 2, "i4")])
    return keys, kinds


def _compare(n_runs: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Reads rows ordered by (bucket, run) and yields the differing keys; holds one bucket's two snapshots at a time."""
    none = (np.empty(0, dtype=[("hi", "u8"), ("lo", "u8")]), np.empty(0, "i8"))
    names: dict[bytes, str] = {}  # of the open bucket's keys that aren't their own name

    def finish(parts: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        hi_lo, order = _order(_bytes16(pdf["key"]))
        for k, n in zip(pdf["key"][pdf["name"].notna()], pdf["name"].dropna()):
            names[k] = n
        return _packed(hi_lo[order]), pdf["row_hash"].to_numpy()[order]

    def emit(run: int, old, new) -> pd.DataFrame:
        keys, kinds = diff_arrays(old, new)
        raw = np.stack([keys["hi"], keys["lo"]], 1).astype(">u8").tobytes()
        each = [raw[i * 16 : i * 16 + 16] for i in range(len(keys))]
        return pd.DataFrame({"run": np.full(len(keys), run, "i4"), "key": each, "name": np.array([names.get(k) for k in each], dtype=object), "kind": kinds})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple[int, int] | None = None
        parts: list[pd.DataFrame] = []
        before: tuple[int, int, tuple] | None = None  # bucket, run, arrays

        def close() -> Iterator[pd.DataFrame]:
            nonlocal before
            bucket, number = at
            if before is not None and before[0] != bucket:
                yield from last()
                names.clear()
            here = finish(parts)
            old = before[2] if before and before[1] == number - 1 else none
            if before and before[1] < number - 1:
                yield emit(before[1] + 1, before[2], none)
            if number > 0:
                yield emit(number, old, here)
            before = (bucket, number, here)

        def last() -> Iterator[pd.DataFrame]:
            nonlocal before
            if before and before[1] < n_runs - 1:
                yield emit(before[1] + 1, before[2], none)
            before = None

        for pdf in frames:
            for key, part in pdf.groupby(["bucket", "run"], sort=False):
                if at is not None and key != at:
                    yield from close()
                    parts = []
                at = key
                parts.append(part)
        if at is not None:
            yield from close()
            yield from last()

    return run


def _known(df: DataFrame, run: Column, key: Sequence[Column]) -> DataFrame:
    known = run.isNotNull()
    for k in key:
        known = known & k.isNotNull()
    return df.where(known)


_GUID = "^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
_APART = "\u001f"


def _whole(key: Sequence[Column]) -> Column:
    """The key as one text."""
    return F.concat_ws(_APART, *[k.cast("string") for k in key])


def _key16(whole: Column) -> Column:
    """16 bytes of a key: a GUID's own, the MD5 of anything else."""
    return F.unhex(F.when(whole.rlike(_GUID), F.replace(whole, F.lit("-"), F.lit(""))).otherwise(F.md5(whole)))


def _names(key16: Column, name: Column, keys: Sequence[str]) -> list[Column]:
    """The parts of a key again: from the name that travelled with it, else from its bytes."""
    guid = F.regexp_replace(F.lower(F.hex(key16)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    whole = F.coalesce(name, guid)
    return [whole.alias(keys[0])] if len(keys) == 1 else [F.split(whole, _APART)[i].alias(k) for i, k in enumerate(keys)]


def compact_snapshots(df: DataFrame, run: Column, key: Sequence[Column], values: Sequence[Column], read_at: Column) -> DataFrame:
    """One row per snapshot and key: run_label, key (16 bytes), name (of a key that is no GUID), row_hash of the reading with the latest ``read_at``.

    Of readings at the same instant the one with the largest row hash holds, so
    the choice does not depend on the order of rows.  Rows whose key or label is NULL don't
    take part.  The aggregate combines before it shuffles, so a key that is read
    very often stays cheap.
    """
    known = _known(df, run, key).select(run.alias("run_label"), _whole(key).alias("whole"), F.struct(read_at.alias("t"), F.xxhash64(*values).alias("h")).alias("v"))
    rows = known.select("run_label", _key16(F.col("whole")).alias("key"), F.when(~F.col("whole").rlike(_GUID), F.col("whole")).alias("name"), "v")
    return rows.groupBy("run_label", "key").agg(F.max("v")["h"].alias("row_hash"), F.max("name").alias("name"))


def labels_of(df: DataFrame, run: Column, key: Sequence[Column]) -> list[str]:
    """The labels of the snapshots in order; at most MAX_SNAPSHOTS of them come to the driver."""
    found = _known(df, run, key).select(run.alias("run_label")).distinct().limit(MAX_SNAPSHOTS + 1).collect()
    if len(found) > MAX_SNAPSHOTS:
        raise ValueError(f"more than {MAX_SNAPSHOTS} snapshots; split the table by label first")
    return sorted(r[0] for r in found)


def changed_keys(compact: DataFrame, labels: list[str], rows: int) -> DataFrame:
    """run_label, key, name and change_kind of the keys that differ between each label and the one before; ``rows`` is how many the table has."""
    spark = compact.sparkSession
    if not labels:
        return spark.createDataFrame([], "run_label string, key binary, name string, change_kind string")
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(labels)), "run int, run_label string"))  # at most MAX_SNAPSHOTS rows
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    placed = compact.join(numbers, "run_label").select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "run", "key", "name", "row_hash")
    placed = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "run")
    found = placed.mapInPandas(_compare(len(labels)), "run int, key binary, name string, kind int")
    kinds = F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair])
    return found.join(numbers, "run").select("run_label", "key", "name", kinds[F.col("kind")].alias("change_kind"))


def snapshot_changes(df: DataFrame, run: Column, key: dict[str, Column], values: dict[str, Column], read_at: Column, with_values: bool = False) -> DataFrame:
    """Records added, removed or changed between each snapshot and the one before.

    ``key`` and ``values`` give names to comparable expressions.  Columns:
    run_label (the later snapshot), the key (as text), change_kind, and with
    ``with_values`` old_* and new_* of each value.  The first snapshot has no
    changes; an empty table gives no rows; a NULL value compares equal to NULL.
    A key that is missing in between comes as removed and, later, as added.  Rows with a NULL label or key
    don't take part; columns that no expression names are ignored.
    """
    spark, keys = df.sparkSession, list(key.values())
    labels = labels_of(df, run, keys)
    changes = changed_keys(compact_snapshots(df, run, keys, list(values.values()), read_at), labels, df.count())
    changes = changes.withColumnsRenamed({"run_label": "__run", "key": "__key", "name": "__name", "change_kind": "__kind"})
    shown = [F.col("__run").alias("run_label"), *_names(F.col("__key"), F.col("__name"), list(key)), F.col("__kind").alias("change_kind")]
    if not with_values:
        return changes.select(*shown)
    checkpoint_dir(spark)
    changes = changes.checkpoint()  # read three times below; the differing keys are few
    # the same reading holds as in the compact form: the latest, and of equal ones the largest row hash
    read = _known(df, run, keys).select(_key16(_whole(keys)).alias("__key"), run.alias("__run"), F.struct(read_at.alias("t"), F.xxhash64(*values.values()).alias("h"), *[v.alias(f"v_{n}") for n, v in values.items()]).alias("__row"))
    read = read.join(changes.select("__key"), "__key", "left_semi").groupBy("__key", "__run").agg(F.max("__row").alias("__row"))
    order = F.broadcast(spark.createDataFrame(list(zip(labels, [None, *labels])), "__run string, __before string"))  # at most MAX_SNAPSHOTS rows
    both = changes.join(order, "__run")
    new = read.select(F.col("__key"), F.col("__run"), F.col("__row").alias("__new"))
    old = read.select(F.col("__key"), F.col("__run").alias("__before"), F.col("__row").alias("__old"))
    joined = both.join(new, ["__key", "__run"], "left").join(old, ["__key", "__before"], "left")
    return joined.select(*shown, *[F.col("__old")[f"v_{n}"].alias(f"old_{n}") for n in values], *[F.col("__new")[f"v_{n}"].alias(f"new_{n}") for n in values])
