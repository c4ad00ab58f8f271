from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_id, hex32, reference_id
from tessera.operators.orphans import integer_key, key_runs, lifetimes, orphan_references
from tessera.operators import snapshot_diff
from tessera.operators.snapshot_diff import diff_arrays, snapshot_changes
from tessera.session import checkpoint_dir

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def at(hours: float) -> datetime:
    return T0 + timedelta(hours=hours)


def changes(df, with_values=False):
    return snapshot_changes(df, F.col("run"), {"k": F.col("k")}, {"v": F.coalesce(F.lower(F.trim("v")), F.lit(""))}, F.col("t"), with_values)


SCHEMA = "run string, k string, v string, t timestamp, key string, bucket int, __key string"


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", 1, "y") for d in data], SCHEMA)


def test_snapshot_changes_cases(spark):
    data = [
        ("r1", "a", "x", at(0)), ("r1", "b", "x", at(0)), ("r1", "c", None, at(0)), ("r1", "d", "x", at(0)),
        ("r2", "a", " X ", at(1)), ("r2", "b", "y", at(1)), ("r2", "c", " ", at(1)), ("r2", "e", "x", at(1)),
        ("r3", "d", "x", at(2)), ("r3", None, "x", at(2)), (None, "a", "x", at(2)),
        ("r2", "b", "x", at(0.5)), ("r2", "b", "y", at(1)), ("r3", "b", "y", None),
    ]
    want = [("r2", "b", "changed"), ("r2", "d", "removed"), ("r2", "e", "added"), ("r3", "a", "removed"), ("r3", "c", "removed"), ("r3", "d", "added"), ("r3", "e", "removed")]
    assert rows(changes(frame(spark, data))) == sorted(want)
    full = {r["k"]: r for r in changes(frame(spark, data), True).where("run_label = 'r2'").collect()}
    assert (full["b"]["old_v"], full["b"]["new_v"]) == ("x", "y") and full["d"]["new_v"] is None and full["e"]["old_v"] is None


def test_snapshot_changes_empty_and_single(spark):
    assert rows(changes(frame(spark, []))) == []
    assert rows(changes(frame(spark, [("r1", "a", "x", at(0))]))) == []


def test_snapshot_changes_against_sets(spark):
    rng = random.Random(5)
    data, held = [], {}
    for run in ("r1", "r2", "r3", "r4"):
        for k in rng.sample(range(300), 200):
            for _ in range(1 + (rng.random() < 0.1)):
                v, t = rng.choice("abc"), at(rng.random() * 100)
                data.append((run, f"k{k}", v, t))
                held[run, f"k{k}"] = max(held.get((run, f"k{k}"), (T0 - timedelta(1), "")), (t, v))
    want, runs = [], ("r1", "r2", "r3", "r4")
    for before, run in zip(runs, runs[1:]):
        for k in {k for r, k in held if r in (before, run)}:
            a, b = held.get((before, k)), held.get((run, k))
            if not a or not b or a[1] != b[1]:
                want.append((run, k, "added" if not a else "removed" if not b else "changed"))
    rng.shuffle(data)
    assert rows(changes(frame(spark, data))) == sorted(want)


def test_diff_arrays_with_equal_leading_halves():
    kind = [("hi", "u8"), ("lo", "u8")]
    old = np.array([(1, 1), (1, 5), (2, 0)], kind), np.array([10, 20, 30])
    new = np.array([(1, 2), (1, 5), (2, 0)], kind), np.array([10, 21, 30])
    keys, kinds = diff_arrays(old, new)
    assert sorted(zip(keys.tolist(), kinds.tolist())) == [((1, 1), 1), ((1, 2), 0), ((1, 5), 2)]


PARENTS = "id string, first timestamp, gone timestamp"
REFS = "row int, ref_id string, ref_at timestamp, run_id string, key_at long, orphan_kind string, id string"


def orphans(spark, parents, refs):
    p = lifetimes(spark.createDataFrame(parents, PARENTS), F.col("id"), F.col("first"), F.col("gone"))
    r = spark.createDataFrame([(*x, "r", 1, "old", "i") for x in refs], REFS)
    return {x["row"]: x["orphan_kind"] for x in orphan_references(r, p).collect()}


def test_orphans_cases(spark):
    parents = [("a", at(0), at(10)), ("a", at(20), None), ("b", at(5), None), ("c", None, None), ("d", at(3), at(3)), ("a", at(0), at(10)), (None, at(0), None)]
    refs = [(1, "a", at(5)), (2, "a", at(10)), (3, "a", at(25)), (4, "b", at(1)), (5, "x", at(1)), (6, "x", None), (7, "a", None), (8, None, at(1)), (9, "c", at(1)), (10, "d", at(3)), (11, "d", at(2)), (12, "a", at(0)), (13, "a", at(-1))]
    assert orphans(spark, parents, refs) == {2: "deleted", 4: "late", 5: "missing", 6: "missing", 9: "deleted", 10: "deleted", 11: "late", 13: "late"}


def test_orphans_empty(spark):
    assert orphans(spark, [], [(1, "a", at(0))]) == {1: "missing"}
    assert orphans(spark, [("a", at(0), None)], []) == {}


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_orphans_against_brute_force(spark, threshold):
    rng = random.Random(9)
    parents = [(f"p{rng.randrange(40)}", at(rng.randrange(200)), rng.choice([None, at(rng.randrange(250))])) for _ in range(90)]
    refs = [(i, "p0" if i % 3 == 0 else f"p{rng.randrange(60)}", rng.choice([at(rng.randrange(220)), None])) for i in range(600)]
    want = {}
    for i, k, t in refs:
        lives = [(a, b) for p, a, b in parents if p == k]
        if not lives:
            want[i] = "missing"
        elif t is not None and not any(a <= t and (b is None or b > t) for a, b in lives):
            want[i] = "late" if all(a > t for a, _ in lives) else "deleted"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert orphans(spark, parents, refs) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ids(spark):
    g = "0AE7F5D3-3e24-4230-8aaf-458aee59f28e"
    data = [(g,), ("{" + g + "}",), (g.replace("-", "").upper(),), (" " + g,), ("x-1",), ("  ",), (None,), ("0" * 32,)]
    df = spark.createDataFrame(data, "c string")
    got = [tuple(r) for r in df.select(canonical_id(F.col("c")), reference_id(F.col("c")), hex32(F.col("c"))).collect()]
    low = g.lower()
    assert [x[0] for x in got[:4]] == [low] * 4 and got[4][0] == "x-1" and got[5][0] is None and got[6][0] is None
    assert got[7][1] is None and got[7][0] is not None and got[4][2] is None


def test_integer_keys_keep_order_and_neighbours(spark):
    ids = ["00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b", "ffffffff-ffff-ffff-ffff-ffffffffffff", "0", "65535", "65536", "123456789012345678", "007", "other", None]
    got = {r["id"]: (r["space"], r["hi"], r["lo"]) for r in spark.createDataFrame([(i,) for i in ids], "id string").select("id", *integer_key(F.col("id"), F.lit(1))).collect()}
    assert got[ids[0]] == (3, 0, 10) and got[ids[1]] == (3, 0, 11) and got[ids[2]] == (3, -1, -1)
    assert [got[i] for i in ("0", "65535", "65536")] == [(4, 0, 0), (4, 0, 65535), (4, 1, 0)] and got["123456789012345678"][0] == 4
    assert got["007"][0] == got["other"][0] == 5 and got[None][0] is None


@pytest.mark.parametrize("bits", [1, 5, 30])
def test_key_runs_compress_neighbours_and_match_as_of(spark, bits):
    rng = random.Random(bits)
    number = lambda n: f"{n:032x}"
    guid = lambda n: "-".join((number(n)[:8], number(n)[8:12], number(n)[12:16], number(n)[16:20], number(n)[20:]))
    base = [rng.getrandbits(128) for _ in range(5)] + [0, 2**64 - 3, 2**128 - 9]
    keys = {b + k for b in base for k in range(6) if rng.random() < 0.8 and b + k < 2**128}
    ids = [guid(k) for k in keys] + [str(k) for k in range(65_530, 65_545) if k != 65_540]
    parents = spark.createDataFrame([(i,) for i in ids * 2], "id string").select(*integer_key(F.col("id")))
    runs = key_runs(parents, bits)
    assert runs.count() < len(ids) and not set(runs.columns) & {"run", "starts"}
    asked = [guid(b + k) for b in base for k in range(-2, 9) if 0 <= b + k < 2**128] + [str(k) for k in range(65_520, 65_560)]
    refs = spark.createDataFrame([(i, at(1)) for i in asked], "ref_id string, ref_at timestamp")
    lives = lifetimes(spark.createDataFrame([(i, at(0), None) for i in ids], PARENTS), F.col("id"), F.col("first"), F.col("gone"))
    got = {r["ref_id"] for r in orphan_references(refs, lives).collect()}
    assert got == set(asked) - set(ids)


def test_keys_travel_as_their_own_bytes_or_by_name(spark):
    g = "0ae7f5d3-3e24-4230-8aaf-458aee59f28e"
    data = [("r1", g, "x", at(0)), ("r1", "b", "x", at(0)), ("r2", "c", "x", at(1)), ("r2", g, "y", at(1)), ("r3", "c", "y", at(2))]
    assert rows(changes(frame(spark, data))) == sorted([("r2", g, "changed"), ("r2", "b", "removed"), ("r2", "c", "added"), ("r3", g, "removed"), ("r3", "c", "changed")])
    two = snapshot_changes(frame(spark, data), F.col("run"), {"k": F.col("k"), "second": F.length("k")}, {"v": F.col("v")}, F.col("t"))
    assert ("r2", "c", "1", "added") in rows(two) and ("r2", g, "36", "changed") in rows(two)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_buckets_by_row_count_change_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(snapshot_diff, "BUCKET_ROWS", size)
    data = [(f"r{r}", f"k{k}", "xyz"[(r * k) % 3], at(r)) for r in range(4) for k in range(30) if (r + k) % 5]
    held = {(r, k): v for r, k, v, _ in data}
    want = []
    for r in range(1, 4):
        for k in range(30):
            a, b = held.get((f"r{r - 1}", f"k{k}")), held.get((f"r{r}", f"k{k}"))
            if a != b:
                want.append((f"r{r}", f"k{k}", "added" if a is None else "removed" if b is None else "changed"))
    assert rows(changes(frame(spark, data))) == sorted(want)


def test_a_cluster_must_name_its_checkpoint_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Cluster:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://head:7077"})

    with pytest.raises(ValueError):
        checkpoint_dir(Cluster)
