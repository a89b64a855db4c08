"""Hard-negative mining: exact search of inner products over k-means inverted lists.

1. Centroids are fitted on a bounded sample (``SAMPLE`` rows for each list, at most ``LISTS`` lists);
   every row is then put into the list of its nearest centroid, in blocks of at most ``BLOCK`` rows.
   A list's radius is the largest distance of a row from its centroid.
2. For an anchor a, no row of a list scores above a.c + |a| r nor below a.c - |a| r (Cauchy-Schwarz).
   An anchor visits lists by falling upper bound, in widening rounds. A list is skipped if all its
   scores lie outside the wanted window; an anchor stops once the bound is strictly below its kth score.
3. Positives are searched first, without a window; then, in one search for all positives of an
   anchor, the negatives in the window of each.

A round is a grid: anchors are dealt in groups of ``ANCHORS``, lists in cells of ``CELL`` rows, and
a task holds one group and one cell, whose blocks it scores one after the other. So a vector is sent
once for each group of anchors and an anchor once for each cell, not once for each list; a list with
very many rows is many blocks over several cells. Within a cell only what reaches an anchor's kth
score so far goes on, and nothing is broadcast but which lists a group visits.

Vectors are made whole numbers first: a component x becomes floor(scale * x). Scores are exact:
products are formed in floats only where the norms show that these hold them exactly, else in
Python's integers. Scores outside 64 bits become the nearest that fits.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no
part; rows equal in id, label and vector are one row; rows that share only their id are rows of
their own, but never partners of an anchor with that id; shorter vectors are filled up with
zeros; ties in score go by id, ascending; anchors without positives or negatives give no rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import ship, staged

#: Lists at most, and sampled rows for each.
LISTS, SAMPLE = 1024, 32
#: Rows of a block, rows of a list that are packed by one task, rows of a cell, anchors of a group, and anchors scored at a time.
BLOCK, PART, CELL, ANCHORS, STEP = 2048, 16_384, 65_536, 8192, 1024
#: Lists visited in the first round; each later round goes on to ``WIDEN`` times as many.
FIRST, WIDEN = 8, 128
_MIN, _MAX = -(1 << 63), (1 << 63) - 1


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of ``a`` and ``b``, which hold whole numbers, as 64-bit integers."""
    norm = lambda m: math.sqrt(float((m.astype(np.float64) ** 2).sum(1).max(initial=0)))
    bound = norm(a) * norm(b)
    # no partial sum of a product is larger than the product of the norms
    for kind, whole in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if bound < 0.99 * whole:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    ints = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(ints(a) @ ints(b).T, _MIN, _MAX).astype(np.int64)


def _matrix(blobs, size: int) -> np.ndarray:
    """Vectors stored as doubles, as rows of ``size``."""
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, size)


def _filled(vectors, size: int, scale: float) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def fitted(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means over a sample; the first centroids are its first different rows."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:lists]]
    for _ in range(rounds):
        own = _nearest(sample, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its distance."""
    own = np.concatenate([np.argmin((centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(1))


def bounds(a: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the scores of each anchor with the rows of each list."""
    size = np.sqrt((a**2).sum(1))[:, None]
    mid, reach = a @ centres.T, size * radii
    slack = 1e-9 * (size * np.sqrt((centres**2).sum(1)) + reach) + 1e-6
    return mid - reach - slack, mid + reach + slack


def visits(a, centres, radii, low, high, kth, first: int, last: int) -> np.ndarray:
    """Whether each anchor visits each list in the round of the places from ``first`` to ``last`` by upper bound.

    ``low``, ``high`` and ``kth`` (the kth score so far) have a column for each window.
    """
    under, over = bounds(a, centres, radii)
    place = np.empty(over.shape, np.int64)
    np.put_along_axis(place, np.argsort(-over, 1, kind="stable"), np.arange(over.shape[1])[None, :], 1)
    out = np.zeros(over.shape, bool)
    least = np.maximum(low, kth)
    for w in range(low.shape[1]):
        out |= (over >= least[:, w : w + 1]) & (under <= high[:, w : w + 1])
    return out & (place >= first) & (place < last)


def _windows(arrays, width: int, fill: int) -> np.ndarray:
    out = np.full((len(arrays), width), fill, np.int64)
    for i, v in enumerate(arrays):
        out[i, : len(v)] = v
    return out


def _probes(centres: np.ndarray, radii: np.ndarray, cells: np.ndarray, first: int, last: int):
    """Each anchor with the lists that it visits, as bits, and the cells that hold these."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in rows:
            for at in range(0, len(whole), STEP):
                pdf = whole.iloc[at : at + STEP]
                width = max(map(len, pdf["low"]))
                a, low, high = _matrix(pdf["x"], centres.shape[1]), _windows(pdf["low"], width, _MAX), _windows(pdf["high"], width, _MIN)
                go = visits(a, centres, radii, low, high, low, first, last)
                into = go.astype(np.float32) @ cells > 0
                yield pdf.assign(visits=[v.tobytes() for v in np.packbits(go, axis=1)], cells=[np.flatnonzero(v).astype(np.int32) for v in into])

    return run


def _bits(blobs, lists: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1), axis=1, count=lists).astype(bool)


def _asked(lists: int):
    """(group, list): the lists that any anchor of a batch visits, by group."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for group, p in pdf.groupby("group"):
                any_of = np.zeros(lists, bool)
                for at in range(0, len(p), STEP):
                    any_of |= _bits(p["visits"].iloc[at : at + STEP], lists).any(0)
                yield pd.DataFrame({"group": group, "list": np.flatnonzero(any_of)})

    return run


def _scored(size: int, k: int, same: bool, lists: int):
    """Of the anchors of a group and the blocks of a cell, each anchor's best rows by window."""

    def best(p: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        q, own, wanted = (p[c].to_numpy(np.int64) for c in ("q", "id", "label"))
        width = max(map(len, p["low"]))
        a, low, high, go = _matrix(p["x"], size), _windows(p["low"], width, _MAX), _windows(p["high"], width, _MIN), _bits(p["visits"], lists)
        slot, score, other = (np.zeros(0, np.int64) for _ in range(3))
        for r in blocks.itertuples():
            at = np.flatnonzero(go[:, r.list])
            if not len(at):
                continue
            ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
            s = exact_products(a[at], np.frombuffer(r.vectors, np.float32 if len(r.vectors) == 4 * size * len(ids) else np.float64).reshape(-1, size))
            i, j = np.nonzero(s >= low[at].min(1)[:, None])
            s, i = s[i, j], at[i]
            ok = ((wanted[i] == labels[j]) == same) & (own[i] != ids[j])
            s, i, j = s[ok], i[ok], j[ok]
            fits = [(s >= low[i, w]) & (s <= high[i, w]) for w in range(width)]
            if not any(f.any() for f in fits):
                continue
            slot = np.concatenate([slot, *(i[f] * width + w for w, f in enumerate(fits))])
            score, other = np.concatenate([score, *(s[f] for f in fits)]), np.concatenate([other, *(ids[j[f]] for f in fits)])
            order = np.lexsort((other, ~score, slot))
            slot, score, other = slot[order], score[order], other[order]
            place = np.arange(len(slot)) - np.searchsorted(slot, slot)
            # rows of later blocks must reach the kth so far
            full = place == k - 1
            low[slot[full] // width, slot[full] % width] = score[full]
            slot, score, other = (v[place < k] for v in (slot, score, other))
        return pd.DataFrame({"q": q[slot // width], "w": slot % width, "score": score, "id": other})

    def run(anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(anchors) or not len(blocks):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("q", "w", "score", "id")})
        return pd.concat([best(anchors.iloc[at : at + STEP], blocks) for at in range(0, len(anchors), STEP)])

    return run


class Lists:
    """Inverted lists over the rows (id, label, x) of a table, stored in blocks."""

    def __init__(self, rows: DataFrame, size: int, lists: int, scale: float):
        self.size, self.spark = size, rows.sparkSession
        n = max(rows.count(), 1)
        pick = F.pmod(F.xxhash64("id", "label"), F.lit(max(1, n // (lists * SAMPLE)))) == 0
        sample = rows.where(pick).select("vector").limit(2 * lists * SAMPLE).toPandas()["vector"]
        self.centres = fitted(_filled(sample if len(sample) else [[]], size, scale), lists)
        centres = self.centres

        def put(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                x = _filled(pdf["vector"], size, scale)
                own, far = _nearest(x, centres)
                yield pd.DataFrame({"list": own, "id": pdf["id"], "label": pdf["label"], "anchor": pdf["anchor"], "x": [v.tobytes() for v in x], "far": far})

        self.rows = staged(rows.mapInPandas(put, "list int, id long, label long, anchor boolean, x binary, far double"), "rows")
        each = self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
        self.radii, n = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in each:
            self.radii[r["list"]], n[r["list"]] = r["far"], r["n"]
        parts = np.maximum(1, -(-n // PART)).tolist()
        # lists one after the other in cells of about CELL rows; a list's parts go round the cells that it reaches into
        begin, end = (np.cumsum(n) - n) // CELL, np.maximum(0, np.cumsum(n) - 1) // CELL
        end = np.maximum(begin, end)
        self.cells = ((begin[:, None] <= np.arange(end.max() + 1)) & (np.arange(end.max() + 1) <= end[:, None])).astype(np.float32)

        def blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, out = pdf.sort_values("id"), []
            cell = begin[key[0]] + key[1] % (end[key[0]] - begin[key[0]] + 1)
            for at in range(0, len(pdf), BLOCK):
                p = pdf.iloc[at : at + BLOCK]
                x = _matrix(p["x"], size)
                if np.abs(x).max(initial=0) < 1 << 24:
                    x = x.astype(np.float32)
                out.append((key[0], cell, p["id"].to_numpy().tobytes(), p["label"].to_numpy().tobytes(), x.tobytes()))
            return pd.DataFrame(out, columns=["list", "cell", "ids", "labels", "vectors"])

        part = F.pmod(F.xxhash64("id"), F.element_at(F.array(*map(F.lit, parts)), F.col("list") + 1))
        self.blocks = staged(self.rows.groupBy("list", part.alias("part")).applyInPandas(blocks, "list int, cell int, ids binary, labels binary, vectors binary"), "lists")

    def anchors(self) -> DataFrame:
        """The rows that are anchors with a number q, in groups of about ``ANCHORS`` that lie in neighbouring lists."""
        asked = staged(self.rows.where("anchor").select("list", "id", "label", "x").withColumn("q", F.monotonically_increasing_id()), "anchors")
        n = np.zeros(len(self.centres), np.int64)
        for r in asked.groupBy("list").count().collect():
            n[r["list"]] = r["count"]
        of = lambda v: F.element_at(F.array(*map(F.lit, v.tolist())), F.col("list") + 1)
        place = of(np.cumsum(n) - n) + F.pmod(F.xxhash64("q"), of(np.maximum(n, 1)))
        return asked.select("q", "id", "label", "x", F.floor(place / ANCHORS).cast("int").alias("group"))

    def best(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, w, score, id) of the best ``k`` rows in each window of each query (q, group, id, label, x, low, high); of its label, or of others."""
        best = self.spark.createDataFrame([], "q long, w int, score long, id long")
        rank = F.row_number().over(Window.partitionBy("q", "w").orderBy(F.desc("score"), "id"))
        fields = "q long, group int, id long, label long, x binary, low array<long>, high array<long>, visits binary, cells array<int>"
        first, last = 0, FIRST
        while first < len(self.centres):
            kth = best.groupBy("q", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
            kth = kth.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
            low = F.transform("low", lambda x, w: F.greatest(x, F.try_element_at("kth", w)))
            told = queries.join(kth, "q", "left").select("q", "group", "id", "label", "x", low.alias("low"), "high")
            probes = staged(told.mapInPandas(_probes(self.centres, self.radii, self.cells, first, last), fields), "probes")
            # at most LISTS rows for each group of anchors
            asked = probes.mapInPandas(_asked(len(self.centres)), "group int, list int").distinct()
            blocks = self.blocks.join(F.broadcast(asked), "list").groupBy("group", "cell")
            sent = probes.withColumn("cell", F.explode("cells")).drop("cells").groupBy("group", "cell")
            found = sent.cogroup(blocks).applyInPandas(_scored(self.size, k, same, len(self.centres)), "q long, w int, score long, id long")
            best = staged(found.unionByName(best).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "best")
            first, last = last, last * WIDEN
        return best


def hard_negatives(rows: DataFrame, anchors: Column, id: str = "id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256) -> DataFrame:
    """The hardest rows of other labels for each anchor and positive.

    ``anchors`` tells which rows are anchors; ``low`` and ``high`` bound a negative's score, in
    percent of the positive's. Returns anchor_id, positive_id, rank, negative_id, positive_score
    and negative_score.
    """
    ship(rows.sparkSession)
    v = F.col(vector)
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    valid = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & whole)
    valid = valid.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    valid = staged(valid.dropDuplicates(["id", "label", "vector"]), "vectors")
    n, size = valid.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    lists = Lists(valid, max(size or 0, 1), max(1, min(LISTS, round(math.sqrt(n) / 2))), scale)
    asked = lists.anchors()
    free = asked.withColumn("low", F.array(F.lit(_MIN))).withColumn("high", F.array(F.lit(_MAX)))
    near = lists.best(free, positives, True)
    # a negative score has no row between its shares: its window is empty
    least = F.expr(f"({low} * CAST(score AS DECIMAL(20)) + 99) div 100")
    most = F.expr(f"({high} * CAST(score AS DECIMAL(20))) div 100")
    near = near.where("score >= 0").groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id").alias("pid"), "score", least.alias("low"), most.alias("high")))).alias("near"))
    asked = staged(asked.join(near, "q"), "windows")
    far = lists.best(asked.select("q", "group", "id", "label", "x", F.col("near.low").alias("low"), F.col("near.high").alias("high")), negatives, False)
    rank = F.row_number().over(Window.partitionBy("q", "w").orderBy(F.desc("score"), "id"))
    out = far.select("q", "w", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(asked.select("q", F.col("id").alias("anchor_id"), "near"), "q")
    own = F.get("near", F.col("w"))
    return out.select("anchor_id", own["pid"].alias("positive_id"), "rank", "negative_id", own["score"].alias("positive_score"), "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors whose vec_id is divisible by 100, against all rows; every seventh label is moved on by one."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0, "vec_id", "label", "embedding")


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, list_dot_product(a.v, o.v)::BIGINT AS score FROM e a JOIN e o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 5
"""
