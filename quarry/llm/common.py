"""What the operators of this subpackage share: the shared folder, staged tables, code shipping and skew-safe joins."""

from __future__ import annotations

import gc
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.staging import new_path, shared_dir, ship, staged  # noqa: F401  (the operators take them from here)

#: A looked-up table is broadcast up to this many rows; beyond it the join is salted.
BROADCAST_ROWS = 50_000


def forget(*tables: DataFrame) -> None:
    """Removes the files of tables made by ``staged`` that nothing reads any more, and lets Spark drop the shuffles behind them."""
    for df in tables:
        spark = df.sparkSession
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs: the context cleaner acts on what the collectors find."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """True for the fifth of the rows that no model learns from; null ids are held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup_join(left: DataFrame, right: DataFrame, key: str | list[str], salt_by: Column, salts: int = 64, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join with a table of unique keys, whatever the skew of ``left``.

    ``right`` is staged and counted. Up to ``max_rows`` rows it is broadcast; beyond, it is
    repeated ``salts`` times and joined on (key, salt), so no key of ``left`` meets in one task.
    """
    right = staged(right, "lookup")
    if right.count() <= max_rows:
        return left.join(F.broadcast(right), key, "left")
    salt = "__quarry_salt"
    l = left.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(salt_by), F.lit(salts)), F.lit(0)).cast("int"))
    r = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # merged, as the planner takes the repeated table for as small as the staged one and would broadcast it
    return l.join(r.hint("merge"), [*([key] if isinstance(key, str) else key), salt], "left").drop(salt)
