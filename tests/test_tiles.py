"""Triangles of graphs given by groups, against brute force."""

import itertools
import random

import numpy as np
import pytest

from quarry.operators import tiles as T


def brute(members):
    near, of = {}, {}
    for g, i in members:
        of.setdefault(g, set()).add(i)
    for v in of.values():
        for a in v:
            near.setdefault(a, set()).update(v - {a})
    return {i: (len(v), sum(y in near[x] for x, y in itertools.combinations(v, 2))) for i, v in near.items() if v}


@pytest.mark.parametrize("nodes, groups, most, side", [(300, 60, 4, 10_000), (1500, 400, 6, 300), (700, 60, 90, 10_000), (40, 3, 40, 10_000), (900, 300, 25, 100)])
def test_triangles_of_groups(spark, monkeypatch, nodes, groups, most, side):
    monkeypatch.setattr(T, "SIDE", side)
    rng = random.Random(nodes)
    members = [(g, f"s{rng.randrange(nodes)}") for g in range(groups) for _ in range(rng.randint(1, most))] + [(0, "s1")] * 5 + [(groups, "alone")]
    df = spark.createDataFrame(members, "group long, id string").repartition(3)
    assert {r["id"]: (r["degree"], r["triangles"]) for r in T.triangles_of_groups(df).collect()} == brute(members)


def test_no_groups(spark):
    assert T.triangles_of_groups(spark.createDataFrame([], "group long, id string")).collect() == []


@pytest.mark.parametrize("large", [1, 40, 1 << 12])
def test_groups_over_several_batches(monkeypatch, large):
    """A group that goes on after a batch is cut as a whole, and pairs are set in parts or by large groups."""
    import pyarrow as pa

    monkeypatch.setattr(T, "MEMBERS", 7)
    monkeypatch.setattr(T, "PAIRS", 5), monkeypatch.setattr(T, "LARGE", large)
    rng, side, t = np.random.default_rng(1), 512, 2
    group = np.sort(rng.integers(0, 9, 120))
    code = rng.integers(0, 2 * 40, 120)
    code = (code // 40 * side + code % 40).astype(np.int32)
    cuts = [pa.RecordBatch.from_arrays([pa.array(group[i : i + 6]), pa.array(code[i : i + 6])], ["group", "code"]) for i in range(0, 120, 6)]
    got = np.zeros((2 * side, 2 * side), bool)
    for b in T._pieces(iter(cuts), t, side):
        for tile, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = divmod(tile, t)
            T._set(got[x * side : x * side + side, y * side : y * side + side], data)
    want = np.zeros_like(got)
    for g in range(9):
        want[np.ix_(code[group == g], code[group == g])] = True
    want[side:, :side] = False
    np.fill_diagonal(want, False), np.fill_diagonal(got, False)
    assert (got == want).all()
    bits = np.packbits(got[:side, :side], axis=1, bitorder="little").view(np.uint64)
    assert (np.unpackbits(T._turned(bits).view(np.uint8), axis=1, bitorder="little") == got[:side, :side].T).all()


def test_no_row_for_an_edge(spark, tmp_path, monkeypatch):
    """What graph_clustering stages grows with suppliers and bits, not with edges or the lists that meet them."""
    from quarry.operators import graph as G
    from quarry.plans import structure

    rng, rows = random.Random(5), []

    def counted(df, label, f=T.staged):
        out = f(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(T, "staged", counted), monkeypatch.setattr(G, "staged", counted)
    lines = [(p, rng.randrange(300)) for p in range(400) for _ in range(25)] + [(None, 1), (1, None)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(301)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {str(i): 0.0 for i in range(301)} | {str(i): round(2 * n / (d * (d - 1)), 9) for i, (d, n) in brute(lines[:-2]).items()}
    assert {r["id"]: r["coefficient"] for r in structure.graph_clustering(spark, str(tmp_path)).collect()} == want
    assert sum(rows) < 1000 < 10_000 < sum(d for d, _ in brute(lines[:-2]).values()) / 2
