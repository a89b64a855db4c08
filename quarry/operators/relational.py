"""Records: lookups, filters, paging, statistics, upserts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class SearchFilters:
    """Filters of a document search; those left empty don't apply."""

    sources: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    content_types: list[str] = field(default_factory=list)
    date_from: object = None
    date_to: object = None
    quality_min: float | None = None
    least_chars: int | None = None

    def condition(self) -> Column:
        c = F.lit(True)
        if self.sources:
            c &= F.col("source").isin(*self.sources)
        if self.languages:
            c &= F.col("lang").isin(*self.languages)
        if self.categories:
            c &= F.col("category").isin(*self.categories)
        if self.content_types:
            c &= F.col("content_type").isin(*self.content_types)
        if self.date_from is not None:
            c &= F.col("created_at") >= F.lit(self.date_from)
        if self.date_to is not None:
            c &= F.col("created_at") <= F.lit(self.date_to)
        for t in self.tags:
            c &= F.array_contains("tags", t)
        if self.quality_min:
            c &= F.col("quality_score") >= self.quality_min
        if self.least_chars:
            c &= F.col("n_chars") >= self.least_chars
        return c


def matching(df: DataFrame, **filters: object) -> DataFrame:
    """Lists select any of their values, scalars equal ones; unknown names are ignored."""
    for k, v in filters.items():
        if k in df.columns:
            df = df.where(F.col(k).isin(*v) if isinstance(v, list | tuple) else F.col(k) == v)
    return df


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of an ordered listing; ValueError unless 1 <= limit <= 100 and offset >= 0."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError(f"limit {limit}, offset {offset}")
    return df.orderBy(*order).offset(offset).limit(limit)


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with that key; the query fails if there are several."""
    found = df.where(F.col(key) == value).limit(2)
    names = df.columns
    one = found.agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in names))).alias("l"))
    sound = F.when(F.size("l") > 1, F.raise_error(F.lit(f"{key} = {value!r} isn't unique"))).otherwise(F.col("l"))
    return one.select(F.explode(sound).alias("x")).select("x.*")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, whose keys are unique, replace those of ``old`` with the same key (see mutation.upsert_last for repeated ones)."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
