"""The tables the engine reads: parquet scans, views, JSON and upload sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Content types an upload may have, and its size limit in bytes: fixed values.
UPLOAD_TYPES = ("text/plain", "text/csv", "application/json", "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
UPLOAD_LIMIT = 10 * 1024 * 1024

PAGE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "content", "content_type", "page_type", "scraped_at")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("links", T.ArrayType(T.StringType()))])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Every table as a temporary view, for SQL."""
    for n in NAMES:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def read_json(spark: SparkSession, path: str, schema: T.StructType = PAGE_SCHEMA) -> DataFrame:
    """Files that each hold a list of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, length, text (UTF-8) of plain files within the size limit."""
    b = spark.read.format("binaryFile").load(path)
    return b.where(F.col("length") <= UPLOAD_LIMIT).select("path", "length", F.decode("content", "UTF-8").alias("text"))


def admissible(df: DataFrame, content_type: str = "content_type", size: str = "file_size") -> DataFrame:
    """The upload gate: known content type and size."""
    return df.where(F.col(content_type).isin(*UPLOAD_TYPES) & (F.col(size) <= UPLOAD_LIMIT))
