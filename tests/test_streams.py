"""Streams against their batch twins: state with timers, restarts, late rows, joins, sessions."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.streaming import keyed as K

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, k string, f string, ttl long"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def land(spark, path, name, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def run(spark, make, out, checkpoint, mode="append"):
    """Runs a stream until what has landed is read, adding its rows to ``out``; returns the progress of its batches."""
    q = make().writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: out.extend(map(tuple, df.collect()))).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q.recentProgress


@pytest.fixture
def store(spark):
    for k, v in K.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in K.STORE:
        spark.conf.unset(k)


def source(spark, path, schema=SCHEMA):
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_keyed_values_with_timers_and_restart(spark, tmp_path, store):
    path, out = str(tmp_path / "in"), []
    rows = [(i, at(i), f"k{i % 3}", f"f{i % 2}", 600 if i % 3 == 0 else 0) for i in range(12)]
    land(spark, path, "a", rows[:5]), land(spark, path, "b", rows[5:8])
    make = lambda: K.keyed_values(source(spark, path)(), "k", "ts", "id", "f", "ttl")
    run(spark, make, out, str(tmp_path / "c"), "update")
    land(spark, path, "c", rows[8:])  # after a restart from the checkpoint
    run(spark, make, out, str(tmp_path / "c"), "update")
    # far later: k0's last value (minute 9, ten minutes to live) ends
    land(spark, path, "d", [(99, at(60), "k1", "f9", 0)]), land(spark, path, "e", [(100, at(61), "k1", "f9", 0)])
    run(spark, make, out, str(tmp_path / "c"), "update")
    last = {}
    for key, value, head, fields, expired in out:
        last[key] = (value, head, fields, expired)
    want = {}
    for k in ("k0", "k1", "k2"):
        mine = [r for r in rows + [(99, at(60), "k1", "f9", 0), (100, at(61), "k1", "f9", 0)] if r[2] == k]
        fields = {r[3]: r[0] for r in mine}
        want[k] = (mine[-1][0], ",".join(str(r[0]) for r in mine[::-1][:3]), ",".join(f"{f}={v}" for f, v in sorted(fields.items())), False)
    want["k0"] = (None, *want["k0"][1:3], True)
    assert last == want


def test_changes_are_forgotten_when_idle(spark, tmp_path, store):
    path, out = str(tmp_path / "in"), []
    make = lambda: K.changes_until_idle(source(spark, path)(), "k", "f", "ts", "id", 600)
    land(spark, path, "a", [(1, at(0), "a", "x", 0), (2, at(1), "a", "y", 0), (3, at(1), "b", "x", 0)])
    run(spark, make, out, str(tmp_path / "c"))
    land(spark, path, "b", [(4, at(2), "a", "z", 0), (5, at(40), "c", "x", 0)])
    land(spark, path, "c", [(6, at(41), "b", "new", 0), (7, at(42), "c", "y", 0)])
    run(spark, make, out, str(tmp_path / "c"))
    assert sorted(out) == [("a", "x", "y", 2), ("a", "y", "z", 4), ("c", "x", "y", 7)]  # b's value had ended


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    path, out = str(tmp_path / "in"), []
    make = lambda: K.session_counts(source(spark, path)(), "ts", "5 minutes", "k", late="10 minutes")
    land(spark, path, "a", [(1, at(0), "a", "", 0), (2, at(3), "a", "", 0), (3, at(60), "a", "", 0)])
    run(spark, make, out, str(tmp_path / "c"))
    land(spark, path, "b", [(4, at(1), "a", "", 0), (5, at(58), "a", "", 0)])  # the first is too late, the second isn't
    land(spark, path, "c", [(6, at(200), "z", "", 0)])
    progress = run(spark, make, out, str(tmp_path / "c"))
    assert sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators) == 1
    assert sorted((k, s, n) for k, s, _, n in out) == [("a", at(0), 2), ("a", at(58), 2)]
    kept = [(1, 0), (2, 3), (3, 60), (5, 58)]
    batch = K.session_counts(spark.createDataFrame([(i, at(m), "a", "", 0) for i, m in kept], SCHEMA), "ts", "5 minutes", "k")
    assert sorted((r["k"], r["start"], r["n"]) for r in batch.collect()) == sorted((k, s, n) for k, s, _, n in out)


def test_streams_join_within_an_interval(spark, tmp_path):
    left, right, out = str(tmp_path / "l"), str(tmp_path / "r"), []
    a = [(1, at(0), "x", "", 0), (2, at(5), "x", "", 0), (3, at(6), "y", "", 0)]
    b = [(11, at(4), "x", "", 0), (12, at(9), "x", "", 0), (13, at(30), "y", "", 0)]
    land(spark, left, "a", a[:2]), land(spark, right, "a", b[:1])
    make = lambda: K.interval_join(source(spark, left)(), source(spark, right)(), "k", "ts", "5 minutes", "10 minutes", "leftOuter").select("id", "r_id")
    run(spark, make, out, str(tmp_path / "c"))
    land(spark, left, "b", a[2:]), land(spark, right, "b", b[1:])
    run(spark, make, out, str(tmp_path / "c"))
    for n, m in (("c", 100), ("d", 200)):
        land(spark, left, n, [(m, at(m), "end", "", 0)]), land(spark, right, n, [(m, at(m), "none", "", 0)])
    run(spark, make, out, str(tmp_path / "c"))
    want = K.interval_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "k", "ts", "5 minutes", kind="leftOuter").select("id", "r_id")
    key = lambda r: (r[0], r[1] or 0)
    assert sorted((r for r in out if r[0] < 50), key=key) == sorted(map(tuple, want.collect()), key=key) == [(1, 11), (2, 12), (3, None)]


def test_first_of_each_forgets(spark, tmp_path):
    path, out = str(tmp_path / "in"), []
    make = lambda: K.first_of_each(source(spark, path)(), ["k"], "ts", "10 minutes").select("id", "k")
    land(spark, path, "a", [(1, at(0), "a", "", 0), (2, at(1), "b", "", 0)])
    land(spark, path, "b", [(3, at(5), "a", "", 0), (4, at(100), "c", "", 0)])
    run(spark, make, out, str(tmp_path / "c"))
    land(spark, path, "c", [(5, at(101), "a", "", 0), (6, at(101), "c", "", 0)])
    run(spark, make, out, str(tmp_path / "c"))
    assert sorted(out) == [(1, "a"), (2, "b"), (4, "c"), (5, "a")]  # a may come again once it is forgotten


def test_stream_of_events_equals_the_batch(spark, tmp_path, store):
    """All events as a stream of several batches: the last rows by key are those of store_values and store_hashes."""
    from quarry.plans import state

    d = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("k"), F.col("event_type").alias("f"), F.lit(0).cast("long").alias("ttl"))
    path, out = str(tmp_path / "in"), []
    for i in range(3):
        e.where(F.floor(F.col("id") / (e.count() / 3)) == i).coalesce(1).write.parquet(f"{path}/{i}")
    run(spark, lambda: K.keyed_values(source(spark, path)(), "k", "ts", "id", "f", "ttl", "365 days"), out, str(tmp_path / "c"), "update")
    last = {r[0]: r for r in out}
    heads = {str(r["user_id"]): r["head"] for r in state.store_values(spark, d).collect()}
    hashes = defaultdict(dict)
    for r in state.store_hashes(spark, d).collect():
        hashes[str(r["user_id"])][r["field"]] = r["value"]
    assert {k: r[2] for k, r in last.items()} == heads
    assert {k: r[3] for k, r in last.items()} == {k: ",".join(f"{f}={v}" for f, v in sorted(h.items())) for k, h in hashes.items()}
