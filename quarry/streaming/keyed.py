"""Keyed values on streams: values, lists and hashes by key with times to live, joins, sessions and duplicates under watermarks.

State is bounded by watermarks and timers: what can't matter any more is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State of keyed values needs a store with several columns.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Entries of a list that are kept.
HEAD = 3


class _Values(StatefulProcessor):
    """By key: the last value with its time to live, the last pushed ones, and the last value of each field."""

    def __init__(self, head: int) -> None:
        self.most = head

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, ttl long")
        self.head = handle.getListState("head", "at long, seq long")
        self.fields = handle.getMapState("fields", "field string", "at long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        head = sorted([tuple(map(int, r)) for r in self.head.get()] + list(zip(new["at"].astype(int), new["seq"].astype(int), strict=True)), reverse=True)[: self.most]
        self.head.put(head)
        for field, at, seq in zip(new["field"], new["at"], new["seq"], strict=True):
            old = self.fields.getValue((field,)) if self.fields.containsKey((field,)) else None
            if old is None or (int(old[0]), int(old[1])) <= (int(at), int(seq)):
                self.fields.updateValue((field,), (int(at), int(seq)))
        at, seq, ttl = (int(new[c].iloc[-1]) for c in ("at", "seq", "ttl"))
        old = self.last.get() if self.last.exists() else None
        if old is None or (int(old[0]), int(old[1])) <= (at, seq):
            self.last.update((at, seq, ttl))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if ttl > 0:
                self.handle.registerTimer((at + 999) // 1000 + ttl * 1000)
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # only the value ends; lists and hashes have no time to live
        self.last.clear()
        yield self._row(key, True)

    def _row(self, key, expired: bool) -> pd.DataFrame:
        last = self.last.get() if self.last.exists() else None
        fields = sorted((f[0], int(v[1])) for f, v in self.fields.iterator())
        head = ",".join(str(int(r[1])) for r in self.head.get())
        return pd.DataFrame({"key": [key[0]], "value": pd.array([None if last is None else int(last[1])], "Int64"), "head": [head], "fields": [",".join(f"{f}={v}" for f, v in fields)], "expired": [expired]})

    def close(self) -> None:
        pass


def keyed_values(stream: DataFrame, key: str, ts: str, seq: str, field: str, ttl: str, late: str = "0 seconds", head: int = HEAD) -> DataFrame:
    """A row for each key that a batch or a timer changes: key, value (the last ``seq``, null once ended), head, fields, expired.

    A value ends ``ttl`` seconds after its time ``ts`` (0: never), by event time: once the
    watermark, ``late`` behind the newest row, passes it. Needs the settings of ``STORE``.
    """
    t = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    t = t.select(F.col(key).cast("string").alias("key"), "__t", F.unix_micros("__t").alias("at"), F.col(seq).cast("long").alias("seq"), F.col(field).alias("field"), F.col(ttl).cast("long").alias("ttl"))
    return t.groupBy("key").transformWithStateInPandas(_Values(head), "key string, value long, head string, fields string, expired boolean", "Update", "EventTime")


class _Changes(StatefulProcessor):
    """By key: the last value, which ends ``idle`` seconds after the key's last row."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, newest, out = (self.last.get() if self.last.exists() else None), 0, []
        for batch in rows:  # a batch of a key at a time; order within a micro-batch is by time
            for at, seq, value in sorted(zip(batch["at"], batch["seq"], batch["value"], strict=True), key=lambda r: (r[0], r[1])):
                # timers fire after a batch's rows, so age is looked at here too: results don't depend on where batches end
                if before is not None and at - before[0] >= self.idle * 1_000_000:
                    before = None
                if before is not None and before[2] != value:
                    out.append((key[0], before[2], value, int(seq)))
                before, newest = (int(at), int(seq), value), max(newest, int(at))
        if before is not None:
            self.last.update(before)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((newest + 999) // 1000 + self.idle * 1000)
        yield pd.DataFrame(out, columns=["key", "before", "value", "seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "before": pd.Series([], dtype=str), "value": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def changes_until_idle(stream: DataFrame, key: str, value: str, ts: str, seq: str, idle_s: int, late: str = "0 seconds") -> DataFrame:
    """key, before, value, seq of each change of ``value`` under ``key``; a key without rows for ``idle_s`` seconds of event time is forgotten."""
    t = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    t = t.select(F.col(key).cast("string").alias("key"), "__t", F.unix_micros("__t").alias("at"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("string").alias("value"))
    return t.groupBy("key").transformWithStateInPandas(_Changes(idle_s), "key string, before string, value string, seq long", "Append", "EventTime")


def interval_join(left: DataFrame, right: DataFrame, key: str, ts: str, within: str, late: str = "10 minutes", kind: str = "inner") -> DataFrame:
    """Rows of ``left`` with those of ``right`` of the same key that come at most ``within`` after them; the right's columns are prefixed by ``r_``.

    Works on two streams, whose state the watermarks bound, and on tables. With ``kind``
    leftOuter, rows of ``left`` come out alone once nothing can match them any more.
    """
    l = left.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    r = right.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    r = r.select(*(F.col(c).alias(f"r_{c}") for c in r.columns))
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col(f"r_{ts}") >= F.col(ts)) & (F.col(f"r_{ts}") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return l.join(r, on, kind)


def first_of_each(stream: DataFrame, ids: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each id; ids are forgotten once the watermark has passed them."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def session_counts(events: DataFrame, ts: str, gap: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Sessions by keys, natively: start, end, n. A gap of ``gap`` or more begins a new one; on a stream, sessions come out once complete."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
