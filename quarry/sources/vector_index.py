"""An inverted-file index over vectors: coarse centroids, and the vectors stored in partitions by their nearest centroid.

A search ranks the centroids, reads the partitions of the nearest cells only, and ranks what it
reads exactly. With all cells it equals the full scan; with few, recall is what the tests state.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.sources.staging import ship

#: Sampled vectors for each centroid, at most, and rounds of fitting.
SAMPLE, ROUNDS = 64, 10
#: Queries of a group, vectors of a part, and of these so many at a time.
GROUP, PART, STEP, BLOCK = 16_384, 65_536, 1024, 4096
#: Distances this much apart may round to one relevance.
UNIT = 2e-6


def fit(emb: DataFrame, cells: int, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """At most ``cells`` centroids (Lloyd's algorithm) of a sample of at most ``SAMPLE`` vectors each, chosen by a hash of the key."""
    n = emb.count()
    one_in = max(1, n // (cells * SAMPLE))
    rows = emb.where((F.pmod(F.xxhash64(key), F.lit(one_in)) == 0) & F.col(vector).isNotNull()).select(vector).limit(2 * cells * SAMPLE).toPandas()[vector]
    x = np.array([np.asarray(v, np.float64) for v in rows]).reshape(len(rows), len(rows[0]) if len(rows) else 0)
    centres = np.unique(x, axis=0) if len(x) else x
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:cells]]
    for _ in range(ROUNDS if len(centres) else 0):
        own = _cell(x, centres)
        n_own = np.bincount(own, minlength=len(centres))[:, None]
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n_own > 0, total / np.maximum(n_own, 1), centres)
    return centres


def _cell(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)


def _assigned(emb: DataFrame, centres: np.ndarray, key: str, vector: str) -> DataFrame:
    ship(emb.sparkSession)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=_cell(np.array([np.asarray(v, np.float64) for v in b[vector]]), centres).astype(np.int32))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in emb.schema)
    return emb.where(F.col(vector).isNotNull()).mapInPandas(put, f"{fields}, cell int")


def build(emb: DataFrame, path: str, cells: int, key: str = "vec_id", vector: str = "embedding") -> None:
    """Writes the index of ``emb`` (null vectors are left out) under ``path``: ``centroids`` and ``vectors``, the latter by cell."""
    centres = fit(emb, cells, key, vector)
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    emb.sparkSession.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    _assigned(emb, centres, key, vector).repartition("cell").write.partitionBy("cell").parquet(f"{path}/vectors")


def centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # a bounded number: the cells
    return np.array([r["centroid"] for r in rows])


def append(emb: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """Adds the vectors whose key isn't in the index yet to the cells that are there."""
    spark = emb.sparkSession
    there = spark.read.parquet(f"{path}/vectors").select(key)
    new = emb.join(there, key, "left_anti").dropDuplicates([key])
    _assigned(new, centroids(spark, path), key, vector).repartition("cell").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def cells_of(spark: SparkSession, path: str, query: list[float], probes: int | None = None) -> list[int]:
    """The cells that a search of ``query`` reads: those of the ``probes`` nearest centroids, or all."""
    c = centroids(spark, path)
    order = np.argsort(((c - np.asarray(query, np.float64)) ** 2).sum(1), kind="stable")
    return order[: len(c) if probes is None else probes].tolist()


def search(spark: SparkSession, path: str, query: list[float], k: int = 10, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, relevance (1 less the squared distance) of the ``k`` nearest vectors in the nearest ``probes`` cells; of all vectors if None."""
    e = spark.read.parquet(f"{path}/vectors")
    if probes is not None:
        e = e.where(F.col("cell").isin(cells_of(spark, path, query, probes)))
    q = F.array(*(F.lit(float(x)) for x in query))
    gap = F.zip_with(vector, q, lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0)))
    return e.select(key, F.round(1 - F.aggregate(gap, F.lit(0.0), lambda s, x: s + x), 6).alias("relevance")).orderBy(F.desc("relevance"), key).limit(k)


def search_many(queries: DataFrame, path: str, k: int = 10, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, key, relevance, rank: the ``k`` nearest of each of ``queries`` (query, vector), in one pass.

    Queries are sent to the cells of their nearest centroids. Queries are dealt in groups of about
    ``GROUP``, a cell in parts of about ``PART`` vectors; a task holds one group and one part, whose
    products bound the distances. Only what these can't exclude from a query's nearest is measured
    exactly, and each query's best of a part go on.
    """
    spark = queries.sparkSession
    ship(spark)
    centres = centroids(spark, path)
    stored = spark.read.parquet(f"{path}/vectors")
    sizes = {r["cell"]: r["count"] for r in stored.groupBy("cell").count().collect()}  # a bounded number: the cells
    groups = max(1, -(-queries.count() // GROUP))
    parts = {c: max(1, -(-n // PART)) for c, n in sizes.items()}
    if not sizes:
        parts = {0: 1}

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.array([np.asarray(v, np.float64) for v in b["q"]])
            near = np.argsort((centres**2).sum(1) - 2 * x @ centres.T, 1, kind="stable")[:, :probes]
            yield b.assign(cells=near.astype(np.int32).tolist())

    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *stored.schema]}
    q = queries.where(F.col("vector").isNotNull()).select("query", F.col("vector").cast("array<double>").alias("q")).mapInPandas(probe, f"query {kinds['query']}, q array<double>, cells array<int>")
    n_parts = F.create_map(*(F.lit(v) for kv in parts.items() for v in kv))
    q = q.select("query", "q", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("group"), F.explode("cells").alias("cell"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.try_element_at(n_parts, F.col("cell")) - 1)))
    part = F.pmod(F.xxhash64(key), F.try_element_at(n_parts, F.col("cell"))).cast("int").alias("part")
    v = stored.select(key, F.col(vector).alias("v"), F.col("cell"), part).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query": asked["query"].iloc[:0], key: held[key].iloc[:0], "relevance": np.zeros(0)})
        x, ids = _matrix(held["v"]), held[key].to_numpy()
        return pd.concat([_best(p["query"].to_numpy(), _matrix(p["q"]), ids, x, k, key) for p in (asked.iloc[at : at + STEP] for at in range(0, len(asked), STEP))])

    by = ["group", "cell", "part"]
    found = q.groupBy(*by).cogroup(v.groupBy(*by)).applyInPandas(nearest, f"query {kinds['query']}, `{key}` {kinds[key]}, relevance double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("relevance"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def _rounded(x: np.ndarray) -> np.ndarray:
    """``x`` to six decimals, halves of the shortest decimal form away from zero, as Spark rounds."""
    scaled = np.abs(x) * 1e6
    out = np.copysign(np.floor(scaled + 0.5) / 1e6, x)
    for i in np.flatnonzero(np.isfinite(x) & (np.abs(np.where(np.isfinite(x), scaled, 0) % 1 - 0.5) < 1e-3)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    large = ~(scaled < 1e12)  # as they are, or too large for a sixth decimal to count
    out[large] = [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP, Context(prec=400))) if np.isfinite(v) else v for v in x[large].tolist()]
    return out


def _best(names: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, key: str) -> pd.DataFrame:
    """query, key, relevance of the ``k`` nearest rows of ``x`` for each row of ``q``, by rounded relevance, then key."""
    slot, place, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    size_q, most = (q**2).sum(1), np.full(len(q), np.inf)
    left = np.column_stack([-2 * q, np.ones(len(q))]).astype(np.float32)
    for at in range(0, len(x), BLOCK):
        b = x[at : at + BLOCK]
        size = (b**2).sum(1)
        # squared distances less the query's square, in single precision, and what rounding may add
        gap = left @ np.column_stack([b, size]).astype(np.float32).T
        slack = (q.shape[1] + 8) * 2.4e-7 * (size_q + size.max(initial=0))
        if at == 0 and k <= len(b):
            seen = np.partition(gap, k - 1, axis=1)[:, k - 1] + size_q + slack
            most = np.where(np.isfinite(seen), seen, np.inf) + UNIT
        # what isn't a number is measured too
        i, j = np.nonzero(~(gap > np.nextafter((most - size_q + slack).astype(np.float32), np.float32(np.inf))[:, None]))
        if not len(i):
            continue
        # summed in order, as the full scan does
        d = np.concatenate([np.cumsum((q[i[s : s + 65_536]] - b[j[s : s + 65_536]]) ** 2, 1)[:, -1] for s in range(0, len(i), 65_536)])
        slot, place, near = np.concatenate([slot, i]), np.concatenate([place, j + at]), np.concatenate([near, _rounded(1 - d)])
        order = np.lexsort((ids[place], np.where(np.isnan(near), -np.inf, -near), slot))
        slot, place, near = slot[order], place[order], near[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        full = nth == k - 1
        most[slot[full]] = np.where(np.isnan(near[full]), np.inf, 1 - near[full] + UNIT)
        slot, place, near = (c[nth < k] for c in (slot, place, near))
    return pd.DataFrame({"query": names[slot], key: ids[place], "relevance": near})
