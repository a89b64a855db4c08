"""Graph traversals and structure, and the vector index, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import vector as V
from quarry.sources import vector_index as I


def graph_of(spark, pairs, ids):
    e = spark.createDataFrame([(a, b, "r") for a, b in pairs], "src string, dst string, rel string")
    return e, spark.createDataFrame([(i,) for i in ids], "id string")


def random_pairs(seed, n, m):
    r = random.Random(seed)
    return sorted({(f"n{r.randint(0, n):02}", f"n{r.randint(0, n):02}") for _ in range(m)})


def adjacent(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b), out[b].add(a)
    return out


@pytest.mark.parametrize("longest, shortest", [(1, 1), (2, 1), (3, 2), (4, 1), (5, 1), (5, 4)])
def test_paths_from_both_ends(spark, longest, shortest):
    pairs = random_pairs(4, 12, 20)
    near, found = adjacent(pairs), []

    def walk(path):
        if path[-1] == "n05" and len(path) > shortest:
            found.append((len(path) - 1, ">".join(path)))
        if len(path) <= longest:
            for x in near[path[-1]] - set(path):
                walk([*path, x])

    walk(["n01"])
    e, _ = graph_of(spark, pairs, [])
    got = [(r["length"], r["path"]) for r in G.paths(e, "n01", "n05", longest, 1000, shortest).collect()]
    assert got == sorted(found)
    assert [(r["length"], r["path"]) for r in G.paths(e, "n01", "n05", longest, 3, shortest).collect()] == sorted(found)[:3]


def test_levels_are_files_not_plans(spark):
    """The plan of a traversal doesn't grow with its radius: what was seen is one scan."""
    e, _ = graph_of(spark, [(f"n{i}", f"n{i + 1}") for i in range(9)], [])
    scans = [G.within(e, "n0", r)._jdf.queryExecution().executedPlan().toString().count("FileScan") for r in (2, 6)]
    assert scans == [1, 1]
    assert {r["node"]: r["distance"] for r in G.within(e, "n0", 6).collect()} == {f"n{i}": i for i in range(7)}
    assert G.within(e, "n0", 20).count() == 10 and G.within(e, "none", 3).count() == 1


def test_components(spark):
    pairs = random_pairs(7, 60, 40) + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("s", "s")]
    ids = sorted({x for p in pairs for x in p} | {"alone"})
    near, want = adjacent(pairs), {}
    for i in ids:
        if i not in want:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = i
                    todo += near[x]
    e, n = graph_of(spark, pairs, ids)
    assert {r["id"]: r["component"] for r in G.components(e, n).collect()} == want


def test_triangles_and_density(spark):
    pairs = random_pairs(8, 25, 120)
    ids = sorted({x for p in pairs for x in p} | {"alone"})
    near = {k: v - {k} for k, v in adjacent(pairs).items()}
    want = {i: 0.0 for i in ids}
    for i, v in near.items():
        if len(v) > 1:
            want[i] = sum(b in near[a] for a in v for b in v) / (len(v) * (len(v) - 1))
    e, n = graph_of(spark, pairs, ids)
    assert {r["id"]: round(r["coefficient"], 9) for r in G.clustering(e, n).collect()} == {i: round(x, 9) for i, x in want.items()}
    m = sum(map(len, near.values())) // 2
    assert tuple(G.density(e, n).first()) == (len(ids), m, 2 * m / (len(ids) * (len(ids) - 1)))
    none, _ = graph_of(spark, [], [])
    assert tuple(G.density(none, n.limit(0)).first()) == (0, 0, 0.0) and G.components(none, n).where("id = component").count() == len(ids)


def test_a_hub_of_many_edges(spark):
    """A hub's edges point to it, so none of its pairs of neighbours is made."""
    i = spark.range(100_000)
    e = i.select(F.lit("hub").alias("src"), F.format_string("%06d", "id").alias("dst"), F.lit("r").alias("rel"))
    e = e.unionByName(i.where("id % 1000 = 0").select(F.format_string("%06d", "id").alias("src"), F.format_string("%06d", F.col("id") + 1).alias("dst"), F.lit("r").alias("rel")))
    t = {r["id"]: (r["degree"], r["triangles"]) for r in G.triangles(e).where("triangles > 0").collect()}
    assert t.pop("hub") == (100_000, 100) and len(t) == 200 and set(t.values()) == {(2, 1)}
    assert G.components(e, e.select(F.col("dst").alias("id")).distinct()).select("component").distinct().count() == 1


def test_similar_by_neighbours(spark):
    pairs = random_pairs(9, 20, 60)
    near = adjacent(pairs)
    ids = sorted(near)
    e, n = graph_of(spark, pairs, ids)
    n = n.withColumn("type", F.lit("t"))
    want = {(i, len(near[i] & near["n03"])) for i in ids if i != "n03" and near[i] & near["n03"]}
    got = G.similar_by_neighbours(e, n, "n03").collect()
    assert {(r["id"], r["shared"]) for r in got} == want
    assert all(abs(r["similarity"] - r["shared"] / len(near[r["id"]] | near["n03"])) < 1e-12 for r in got)


# ---- the vector index


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.3 * r.normal(size=16)]) for i in range(1200)] + [(9999, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_index_recall_and_exact_search(spark, vectors, tmp_path):
    path = str(tmp_path / "index")
    I.build(vectors.where("vec_id % 4 <> 0 OR vec_id = 9999"), path, 24)
    I.append(vectors.where("vec_id % 4 = 0"), path)
    I.append(vectors, path)  # nothing new
    assert spark.read.parquet(f"{path}/vectors").count() == 1200
    hits = 0
    for a in range(0, 1200, 60):
        q = vectors.where(F.col("vec_id") == a).first()["embedding"]
        want = [tuple(r) for r in V.nearest(vectors.where("embedding IS NOT NULL"), a).collect()]
        assert [tuple(r) for r in I.search(spark, path, q).collect()] == want
        hits += len({w[0] for w in want} & {r["vec_id"] for r in I.search(spark, path, q, probes=4).collect()})
    assert hits >= 0.9 * 200
    many = vectors.where("vec_id % 60 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    assert I.search_many(many, path, 10, 4).count() == 200
    assert I.search_many(many, path, 10, 4).where("rank = 1 AND query = vec_id").count() == 20


def test_index_reads_only_the_probed_cells(spark, vectors, tmp_path):
    path = str(tmp_path / "index")
    I.build(vectors, path, 24)
    q = vectors.where("vec_id = 5").first()["embedding"]
    plan = I.search(spark, path, q, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    files = I.search(spark, path, q, probes=3).inputFiles()
    df = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(I.cells_of(spark, path, q, 3)))
    assert df.count() < 600 and len(files) >= 3


def test_index_of_nothing(spark, vectors, tmp_path):
    path = str(tmp_path / "index")
    I.build(vectors.where("vec_id = 9999"), path, 4)
    assert I.centroids(spark, path).size == 0
