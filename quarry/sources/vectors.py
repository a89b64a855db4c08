"""Vectors in parquet files: saved, appended by key, loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _with_metadata(df: DataFrame, model: str, size: int, key: str) -> DataFrame:
    """Vectors of another size are refused when they are written."""
    sound = F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector isn't of size {size}")).cast(df.schema["embedding"].dataType))
    return df.select(key, sound.alias("embedding"), F.lit(model).alias("model"), F.lit(size).alias("dimension"), F.current_timestamp().alias("created_at"))


def save(df: DataFrame, path: str, model: str, size: int, key: str = "vec_id") -> None:
    _with_metadata(df, model, size, key).write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str, model: str, size: int, key: str = "vec_id") -> None:
    """Adds the vectors whose key isn't there yet."""
    there = load(df.sparkSession, path).select(key)
    _with_metadata(df.join(there, key, "left_anti").dropDuplicates([key]), model, size, key).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
