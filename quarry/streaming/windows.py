"""Windows, rate limits and change detection over event streams; each has a batch form and works on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.fixed import DEFAULT_LIMIT, RATE_LIMITS


def rate_limit(events: DataFrame, client: str, ts: str, order: str, limit: int, unit: str = "hour") -> DataFrame:
    """Each request with its rank in its client's window and whether it is allowed."""
    w = W.partitionBy(client, F.date_trunc(unit, ts)).orderBy(ts, order)
    return events.withColumn("rank", F.row_number().over(w)).withColumn("allowed", F.col("rank") <= limit)


def changes(events: DataFrame, key: str, value: str, ts: str, order: str) -> DataFrame:
    """Rows whose value differs from the one before under the same key."""
    w = W.partitionBy(key).orderBy(ts, order)
    return events.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def tumbling(events: DataFrame, ts: str, size: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, ts: str, size: str, step: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, size, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap_s: int, key: str) -> DataFrame:
    """Sessions by key: a gap of ``gap_s`` seconds or more, of rounded times, begins a new one."""
    w = W.partitionBy(key).orderBy(ts, "event_id")
    # whole seconds by rounding, halves to the even one: cutting off their fractions makes some gaps a second shorter or longer
    t = F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).cast("long")
    s = events.withColumn("new", F.coalesce((t - F.lag(t).over(w) >= gap_s).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(w))
    return s.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"))


def streaming_counts(stream: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    """Tumbling counts of a stream with a watermark (the time column as TIMESTAMP)."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return tumbling(s, ts, size, *keys)


def rate_limit_by_endpoint(requests: DataFrame, client: str, path: str, ts: str, order: str, unit: str = "minute") -> DataFrame:
    """Each request with its rank in its client's and endpoint's window, and whether the endpoint's limit allows it."""
    limit = F.lit(DEFAULT_LIMIT)
    for prefix, n in reversed(RATE_LIMITS):
        limit = F.when(F.col(path).startswith(prefix), n).otherwise(limit)
    w = W.partitionBy(client, path, F.date_trunc(unit, ts)).orderBy(ts, order)
    return requests.withColumn("rank", F.row_number().over(w)).withColumn("allowed", F.col("rank") <= limit)


def live(values: DataFrame, now: DataFrame, ts: str, ttl: str) -> DataFrame:
    """``values`` that haven't expired at ``now`` (one row); a time to live of 0 or less never ends."""
    age = F.col("now") - F.col(ts)
    return values.join(F.broadcast(now)).where((F.col(ttl) <= 0) | (age < F.make_dt_interval(secs=F.col(ttl).cast("decimal(18,6)")))).drop("now")


def feed(spark, path: str, schema: str) -> DataFrame:
    """A stream of JSON records landed as files: conditions, forecasts and alerts."""
    return spark.readStream.schema(schema).json(path)


#: Records of a feed of conditions.
CONDITIONS = "station string, at timestamp, current struct<temperature:string,humidity:string,wind:string>, forecast array<struct<day:string,high:double,low:double>>, alerts array<string>"


def reading(c):
    """The number in a reading such as ``31.5 °C``; null without one."""
    return F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def conditions(stream: DataFrame) -> DataFrame:
    """station, at, temperature, humidity, wind, alerts of a feed."""
    return stream.select("station", "at", *(reading(F.col(f"current.{c}")).alias(c) for c in ("temperature", "humidity", "wind")), F.size("alerts").alias("alerts"))
