"""Clusters, components and dimensions of vectors against numpy, and the graph built from texts against plain Python."""

from collections import defaultdict

import numpy as np
import pytest

from quarry.operators import extraction as E
from quarry.operators import vector as V
from quarry.plans import knowledge


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(4, 8))[np.arange(200) % 4] * 6 + r.normal(size=(200, 8)) * np.linspace(0.2, 1.0, 8)
    rows = [(i, [float(v) for v in x[i]], i % 4) for i in range(200)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_clusters_are_those_of_separated_groups(vectors):
    _, df = vectors
    by = defaultdict(set)
    for r in V.kmeans(df, 4).collect():
        by[r["cluster"]].add(r["vec_id"] % 4)
    assert len(by) == 4 and all(len(v) == 1 for v in by.values())


def test_components_are_those_of_the_decomposition(vectors):
    x, df = vectors
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = np.array([r["components"] for r in V.pca(df, 2).orderBy("vec_id").collect()])
    want = x @ axes[:2].T  # not centred, as components of the rows themselves
    for k in range(2):
        assert min(np.abs(got[:, k] - s * want[:, k]).max() for s in (1, -1)) < 1e-6


def test_intrinsic_dimension_is_that_of_the_variances(vectors):
    x, df = vectors
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert tuple(V.intrinsic_dimension(df, 0.95).first()) == (int((np.cumsum(s / s.sum()) < 0.95).sum()) + 1, 8)


def test_clustering_quality_of_separated_groups(vectors):
    x, df = vectors
    row = V.clustering_quality(df, "label", 4).first().asDict()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    own = np.arange(200) % 4
    mean = np.array([[d[i][(own == c) & (np.arange(200) != i)].mean() for c in range(4)] for i in range(200)])
    a, b = mean[np.arange(200), own], np.array([min(m[c] for c in range(4) if c != own[i]) for i, m in enumerate(mean)])
    assert abs(row["silhouette"] - ((b - a) / np.maximum(a, b)).mean()) < 5e-3 and row["accuracy"] == 1.0


def test_edges_of_the_built_graph(spark):
    notes = knowledge.notes(spark, "/root/testdata/sf0.001")
    node = lambda name, kind: f"{name.lower()}:{kind}"
    ids = {node(r["name"], r["type"]) for r in E.pattern_mentions(notes).collect()}
    allowed = {(r["rel"], r["src_type"], r["dst_type"]) for r in E.ontology(spark).collect()}
    want = defaultdict(set)
    for r in E.pattern_relations(notes).collect():
        if (r["rel"], r["src_type"], r["dst_type"]) in allowed:
            want[node(r["source"], r["src_type"]), node(r["target"], r["dst_type"]), r["rel"]].add(r["doc_id"])
    for r in E.cooccurring(E.pattern_mentions(notes)).collect():
        want[node(r["source"], r["src_type"]), node(r["target"], r["dst_type"]), r["rel"]].add(r["doc_id"])
    want = {k: len(v) for k, v in want.items() if k[0] in ids and k[1] in ids}
    nodes, edges = E.build_graph(notes)
    assert {(r["src"], r["dst"], r["rel"]): r["n_docs"] for r in edges.collect()} == want and want
    assert {r["id"] for r in nodes.collect()} == ids
