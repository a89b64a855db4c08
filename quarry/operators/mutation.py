"""Mutations of tables and graphs as new snapshots: each returns what the table is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key is neither in ``old`` nor null; of repeated keys in ``new`` one row."""
    fresh = new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def rejected(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` that ``insert`` refuses for their key: the integrity errors."""
    return new.join(old.select(key), key, "left_semi").unionByName(new.where(F.col(key).isNull()))


def update(old: DataFrame, key: str, value: object, now: Column, **fields: object) -> DataFrame:
    """``old`` with ``fields`` and updated_at set in the row of that key; other rows keep theirs."""
    hit = F.coalesce(F.col(key) == value, F.lit(False))
    before = F.col("updated_at") if "updated_at" in old.columns else F.lit(None).cast("timestamp_ntz")
    out = old.withColumn("updated_at", F.when(hit, now).otherwise(before))
    for k, v in fields.items():
        out = out.withColumn(k, F.when(hit, F.lit(v).cast(old.schema[k].dataType)).otherwise(F.col(k)))
    return out


def delete(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``gone`` (a table of tombstones)."""
    return old.join(gone.select(key), key, "left_anti")


def deletions(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """key, deleted: whether each tombstone hit a row."""
    return gone.select(key).distinct().join(old.select(key).distinct().withColumn("deleted", F.lit(True)), key, "left").select(key, F.coalesce("deleted", F.lit(False)).alias("deleted"))


def merge_nodes(old: DataFrame, new: DataFrame, key: str, order: str, props: str = "properties") -> DataFrame:
    """Upsert by ``key``: of repeated new rows the last by ``order`` wins in each property, and new properties win over old ones.

    Both tables have ``key`` and a map ``props``; ``new`` has ``order`` too.
    """
    entries = old.select(key, F.lit(None).cast(new.schema[order].dataType).alias(order), F.lit(0).alias("side"), F.explode_outer(props).alias("k", "v"))
    entries = entries.unionByName(new.select(key, order, F.lit(1).alias("side"), F.explode_outer(props).alias("k", "v")))
    last = entries.groupBy(key, "k").agg(F.max_by("v", F.struct("side", order)).alias("v"))
    merged = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))))
    return last.groupBy(key).agg(merged.alias(props))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the ids of ``gone`` and the edges at them."""
    ids = gone.select("id").distinct()
    kept = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept.select(*edges.columns)


def clear(df: DataFrame) -> DataFrame:
    """The empty table of the same columns."""
    return df.limit(0)


def create_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` and those of ``new`` whose ends both exist; several edges between two nodes are allowed."""
    ids = nodes.select("id").distinct()
    sound = new.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return edges.unionByName(sound.select(*edges.columns))


def dangling(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of ``new`` with an end that doesn't exist: what a load drops."""
    ids = nodes.select("id").distinct()
    start = new.join(ids.select(F.col("id").alias("src")), "src", "left_anti")
    end = new.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return start.select(*new.columns).unionByName(end.select(*new.columns))


def import_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; columns that one lacks are null."""
    return nodes.unionByName(new, allowMissingColumns=True)


def upsert_last(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; of repeated keys the last in ``order`` counts."""
    w = W.partitionBy(key).orderBy(*order)
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    last = new.withColumn("__rn", F.row_number().over(w)).withColumn("__n", n).where("__rn = __n").drop("__rn", "__n")
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)
