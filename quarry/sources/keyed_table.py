"""Tables stored in buckets of their key: a merge rewrites only the buckets it hits and swaps a manifest.

A manifest lists, for a version, the folder of each bucket. Readers read the newest whole one, so
a merge that fails before its manifest is there leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifest(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, f"{path}/manifests")
    names = sorted(str(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifests/{names[-1]}", wholetext=True).collect()))


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Writes a manifest beside its place and renames it there: it is there whole or not at all; a version that is taken makes it fail."""
    fs, at = _fs(spark, f"{path}/manifests/{manifest['version']:010d}.json")
    _, draft = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise RuntimeError(f"version {manifest['version']} of {path} was written by another merge")


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: str, buckets: int, version: int) -> dict[str, str]:
    """Writes the rows by bucket; the folder of each bucket that has some."""
    spark, folder = df.sparkSession, f"data/{version:010d}-{uuid.uuid4().hex}"
    df.withColumn("__bucket", bucket(key, buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/{folder}")
    fs, p = _fs(spark, f"{path}/{folder}")
    names = [str(s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory()]
    return {n.removeprefix("__bucket="): f"{folder}/{n}" for n in names if n.startswith("__bucket=")}


def create(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A new table with the rows of ``df``, whose keys are unique."""
    places = _write(df, path, key, buckets, 0)
    _publish(df.sparkSession, path, {"version": 0, "key": key, "buckets": buckets, "schema": df.schema.json(), "places": places})


def _read(spark: SparkSession, path: str, manifest: dict, only: set[str] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    at = [f"{path}/{f}" for b, f in manifest["places"].items() if only is None or b in only]
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _manifest(spark, path))


def merge(new: DataFrame, path: str, order: list[Column] | None = None, delete: Column | None = None) -> list[int]:
    """Upserts ``new`` by the table's key: columns it lacks stay as they are; of several rows of a key the last in ``order`` counts.

    Rows of ``new`` for which ``delete`` holds remove their key. Returns the buckets that were
    rewritten; the files of all others stay in place.
    """
    spark = new.sparkSession
    m = _manifest(spark, path)
    key, n = m["key"], m["buckets"]
    if order:
        new = new.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*(c.desc() for c in order)))).where("__rn = 1").drop("__rn")
    gone = F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)
    new = new.withColumn("__gone", gone).withColumn("__there", F.lit(True)).persist()
    try:
        hit = sorted(r[0] for r in new.select(bucket(key, n)).distinct().collect())  # at most ``buckets`` numbers
        old = _read(spark, path, m, {str(b) for b in hit})
        own = [c for c in new.columns if c not in ("__gone", "__there", key) and c in old.columns]
        j = old.withColumn("__old", F.lit(True)).alias("o").join(new.alias("n"), key, "full").where(~F.coalesce("n.__gone", F.lit(False)))
        pick = lambda c: F.when(F.col("n.__there"), F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")) if c in own else F.col(key) if c == key else F.col(f"o.`{c}`")
        places = _write(j.select(*(pick(c).alias(c) for c in old.columns)), path, key, n, m["version"] + 1)
        kept = {b: f for b, f in m["places"].items() if int(b) not in hit}
        _publish(spark, path, m | {"version": m["version"] + 1, "places": kept | places})
    finally:
        new.unpersist()
    return hit
