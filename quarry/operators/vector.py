"""Vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def most_similar(emb: DataFrame, anchor: int, k: int = 5) -> DataFrame:
    """The ``k`` vectors nearest to ``vec_id = anchor`` by cosine, itself left out."""
    q = emb.where(F.col("vec_id") == anchor).select(F.col("embedding").alias("q"))
    s = emb.where(F.col("vec_id") != anchor).join(F.broadcast(q))
    return s.select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def nearest(emb: DataFrame, anchor: int, k: int = 10) -> DataFrame:
    """doc_id, relevance (1 less the squared distance to the anchor) of the ``k`` nearest."""
    q = emb.where(F.col("vec_id") == anchor).select(F.col("embedding").alias("q"))
    gap = F.zip_with("embedding", "q", lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    e = emb.join(F.broadcast(q)).select(F.col("vec_id").alias("doc_id"), F.round(1 - F.aggregate(gap, F.lit(0.0), lambda s, x: s + x), 6).alias("relevance"))
    return e.orderBy(F.desc("relevance"), "doc_id").limit(k)


def semantic(docs: DataFrame, emb: DataFrame, anchor: int, k: int = 10) -> DataFrame:
    """doc_id, text, source, relevance: the nearest vectors that have a document; the top is taken before texts are read."""
    held = emb.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").unionByName(emb.where(F.col("vec_id") == anchor).join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti"))
    top = nearest(held, anchor, k)  # at most k rows
    return docs.join(F.broadcast(top), "doc_id").select("doc_id", "text", "source", "relevance").orderBy(F.desc("relevance"), "doc_id").limit(k)


def keyword(docs: DataFrame, word: str, k: int = 10) -> DataFrame:
    return docs.where(F.col("text").ilike(f"%{word}%")).select("doc_id", "text", "source").orderBy("doc_id").limit(k)


def fuse(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Two legs (doc_id, text, source, score, leg) fused: the first occurrence of a title (here the source) and a text's first hundred characters wins."""
    u = a.unionByName(b).withColumn("key", F.concat_ws(":", F.coalesce("source", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 100)))
    first = W.partitionBy("key").orderBy("leg", F.desc("score"), "doc_id")
    return u.withColumn("rn", F.row_number().over(first)).where("rn = 1").orderBy(F.desc("score"), "leg", "doc_id").limit(k).select("doc_id", "score", "leg", F.substring("text", 1, 500).alias("preview"))


def hybrid(docs: DataFrame, emb: DataFrame, anchor: int, word: str, k: int = 10, boost: float = 1.2, fixed: float = 0.8) -> DataFrame:
    """Semantic scores times ``boost`` and keyword hits at ``fixed``, fused."""
    a = semantic(docs, emb, anchor, k).select("doc_id", "text", "source", F.round(F.col("relevance") * boost, 6).alias("score"), F.lit(0).alias("leg"))
    b = keyword(docs, word, k).select("doc_id", "text", "source", F.lit(fixed).alias("score"), F.lit(1).alias("leg"))
    return fuse(a, b, k)


def search(docs: DataFrame, emb: DataFrame, kind: str, anchor: int, word: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """doc_id, score of a page of a search of ``kind`` semantic, keyword or hybrid; ValueError for another one."""
    if kind not in ("semantic", "keyword", "hybrid"):
        raise ValueError(f"unknown kind of search: {kind}")
    n = limit + offset
    hits = {
        "semantic": lambda: semantic(docs, emb, anchor, n).select("doc_id", F.col("relevance").alias("score")),
        "keyword": lambda: keyword(docs, word, n).select("doc_id", F.lit(0.8).alias("score")),
        "hybrid": lambda: hybrid(docs, emb, anchor, word, n).select("doc_id", "score"),
    }[kind]()
    return hits.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)


def health(emb: DataFrame, dim: int) -> DataFrame:
    """Counts of vectors by whether size and values are sound."""
    ok = (F.size("embedding") == dim) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return emb.groupBy(ok.alias("healthy")).agg(F.count(F.lit(1)).alias("n"))


def confidence(hits: DataFrame, by: str, score: str) -> DataFrame:
    """0.7 of the mean score and 0.3 of how close the hits come to five, at most 1."""
    g = hits.groupBy(by).agg(F.avg(score).alias("m"), F.count(F.lit(1)).alias("n"))
    return g.select(by, F.round(F.least(F.lit(1.0), 0.7 * F.col("m") + 0.3 * F.least(F.col("n") / 5, F.lit(1.0))), 6).alias("confidence"))


def pairwise_distances(emb: DataFrame, block: str) -> DataFrame:
    """Mean and deviation of cosine distances of all pairs (in the row whose block is null), and of the pairs of each block.

    From moments, without making pairs: with unit vectors u, the cosines of all pairs sum to
    half of ``|sum u|^2`` less the vectors' own, and their squares to half of
    ``||sum u u'||^2`` less the same. Vectors that are null, zero or of another size have cosine 0.
    """
    kind = emb.schema[block].dataType.simpleString()

    def moments(batches):
        """Per block and size: [vectors, sum of |u|^2, sum of |u|^4, sum u, sum u u']."""
        import numpy as np
        import pandas as pd

        kept = {}

        def rows():
            keys, values = list(kept), [v.tolist() for v in kept.values()]
            kept.clear()
            return pd.DataFrame({"block": pd.Series([k[0] for k in keys], dtype=object), "size": [k[1] for k in keys], "m": pd.Series(values, dtype=object)})

        for batch in batches:
            vectors = [None if x is None else np.asarray(x, np.float64) for x in batch["embedding"]]
            sizes = np.array([0 if x is None or np.isnan(x).any() else len(x) for x in vectors])
            blocks = batch["block"].astype(object).where(batch["block"].notna(), None)
            for (name, size), at in pd.Series(range(len(batch))).groupby([blocks.to_numpy(), sizes], dropna=False).indices.items():
                name = None if pd.isna(name) else name
                u = np.stack([vectors[i] for i in at]) if size else np.zeros((len(at), 0))
                norm = np.sqrt((u * u).sum(1, keepdims=True))
                u = np.divide(u, norm, out=np.zeros_like(u), where=norm > 0)
                own = (u * u).sum(1)
                m = np.concatenate(([len(at), own.sum(), (own * own).sum()], u.sum(0), (u.T @ u).ravel()))
                key = (name, int(size))
                kept[key] = kept[key] + m if key in kept else m
            if len(kept) > 256:  # so many blocks don't fill the memory
                yield rows()
        yield rows()

    part = emb.select(F.col(block).cast("string").alias("block"), "embedding").mapInPandas(moments, "block string, size int, m array<double>")
    both = F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("block")), F.struct(F.lit(False).alias("whole"), F.col("block").alias("block")))
    part = part.select(F.explode(both).alias("b"), "size", "m").select("b.whole", "b.block", "size", F.posexplode("m").alias("pos", "v"))
    part = part.where("whole OR block IS NOT NULL").groupBy("whole", "block", "size", "pos").agg(F.sum("v").alias("v"))
    at = lambda i: F.sum(F.when(F.col("pos") == i, F.col("v")).otherwise(0.0))
    is_sum = (F.col("pos") >= 3) & (F.col("pos") < 3 + F.col("size"))
    square = lambda ok: F.sum(F.when(ok, F.col("v") * F.col("v")).otherwise(0.0))
    g = part.groupBy("whole", "block").agg(at(0).alias("n"), ((square(is_sum) - at(1)) / 2).alias("c1"), ((square(F.col("pos") >= 3 + F.col("size")) - at(2)) / 2).alias("c2"))
    g = g.withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2).where("pairs > 0")
    c = F.col("c1") / F.col("pairs")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("c2") / F.col("pairs") - c * c))
    return g.select(F.col("block").cast(kind).alias(block), F.round(1 - c, 6).alias("mean"), F.round(deviation, 6).alias("deviation"), F.col("pairs").cast("long").alias("pairs"))


def kmeans(emb: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """vec_id and its cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = emb.select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=k, seed=seed).fit(x).transform(x).select("vec_id", F.col("prediction").alias("cluster"))


def pca(emb: DataFrame, k: int = 2) -> DataFrame:
    """vec_id and its first ``k`` components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = emb.select("vec_id", array_to_vector("embedding").alias("features"))
    return PCA(k=k, inputCol="features", outputCol="pc").fit(x).transform(x).select("vec_id", vector_to_array("pc").alias("components"))


def intrinsic_dimension(emb: DataFrame, share: float = 0.95) -> DataFrame:
    """One row: how many principal components reach ``share`` of the variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    size = emb.select(F.max(F.size("embedding"))).first()[0]
    parts = PCA(k=size, inputCol="x", outputCol="pc").fit(emb.select(array_to_vector("embedding").alias("x"))).explainedVariance.toArray()
    n = int((parts.cumsum() < share).sum()) + 1
    return emb.sparkSession.createDataFrame([(min(n, size), size)], "dimension int, of int")


def clustering_quality(emb: DataFrame, label: str = "label", k: int = 5) -> DataFrame:
    """One row: silhouette of a k-means clustering, and its accuracy under the best matching of clusters to labels.

    The contingency table has k times the number of labels cells, whatever the input; the matching is an assignment by shortest augmenting paths.
    """
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    x = emb.select(F.col(label).alias("label"), array_to_vector("embedding").alias("features"))
    found = KMeans(k=k, seed=42).fit(x).transform(x)
    cells = found.groupBy("label", "prediction").count().collect()
    labels = sorted({r["label"] for r in cells if r["label"] is not None})
    n = max(k, len(labels))
    cost = np.zeros((n, n))
    for r in cells:
        if r["label"] is not None:
            cost[r["prediction"], labels.index(r["label"])] = -r["count"]
    hit = -sum(cost[i, j] for i, j in enumerate(assignment(cost)))
    total = sum(r["count"] for r in cells)
    return emb.sparkSession.createDataFrame([(float(ClusteringEvaluator().evaluate(found)), float(hit / total))], "silhouette double, accuracy double")


def assignment(cost) -> list[int]:
    """The column of each row in the cheapest perfect matching of a square matrix."""
    import numpy as np

    n = len(cost)
    u, v, match = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for i in range(n):
        match[n], j0 = i, n
        low, back, used = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while match[j0] >= 0:
            used[j0] = True
            row = match[j0]
            gap = cost[row] - u[row] - v[:n]
            better = ~used[:n] & (gap < low)
            low[better], back[better] = gap[better], j0
            free = np.where(used[:n], np.inf, low)
            j1 = int(free.argmin())
            delta = free[j1]
            for j in np.flatnonzero(used):
                u[match[j]] += delta
                v[j] -= delta
            low[~used[:n]] -= delta
            j0 = j1
        while j0 != n:
            match[j0] = match[back[j0]]
            j0 = int(back[j0])
    out = [0] * n
    for j in range(n):
        out[match[j]] = j
    return out


def embedded(df: DataFrame, text: str = "text", size: int = 64) -> DataFrame:
    """``df`` with ``embedding``: a unit vector of hashed word counts, made once for each distinct text (by MD5)."""
    key = "__md5"
    t = df.withColumn(key, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    once = t.groupBy(key).agg(F.first(text).alias("t"))
    words = once.select(key, F.explode(F.filter(F.split(F.lower(F.coalesce("t", F.lit(""))), r"\s+"), lambda w: w != "")).alias("w"))
    c = words.groupBy(key, F.pmod(F.crc32("w"), F.lit(size)).cast("int").alias("i")).agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
    norm = F.sqrt(F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, x: s + x * x))
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.round(F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("norm"), 6))
    e = c.withColumn("norm", norm).select(key, vector.alias("embedding"))
    zero = F.array_repeat(F.lit(0.0), size)
    return t.join(e, key, "left").select(*df.columns, F.coalesce("embedding", zero).alias("embedding"))
