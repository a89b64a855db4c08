import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import hardneg as hn


def brute(rows, anchor, k=5):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = sorted({(i, l, tuple(v)): (i, l, v) for i, l, v in good}.values())
    out = []
    for a in (g for g in good if anchor(g[0])):
        scored = sorted((-sum(x * y for x, y in zip(a[2], o[2])), o[0], o[1]) for o in good if o[0] != a[0])
        for s, p, _ in [x for x in scored if x[2] == a[1]][:k]:
            far = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a[0], p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(far)]
    return sorted(out)


def mined(spark, rows, every=10, **more):
    df = spark.createDataFrame([(*r, *more.values()) for r in rows], "vid long, lab int, vec array<float>" + "".join(f", {c} string" for c in more))
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vid") % every == 0, "vid", "lab", "vec").collect())


def clustered(seed, n, dims=6, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dims))
    return [(i, int(r.integers(4)), [float(np.float32(x)) for x in centres[i % 8] + spread * r.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.15, 2.0])
def test_random_vectors(spark, spread):
    rows = clustered(1, 600, spread=spread)
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows) == want


def test_small_blocks_and_many_rounds(spark, monkeypatch):
    for name, v in {"BLOCK": 16, "PART": 50, "ANCHORS": 7, "FIRST": 1, "WIDEN": 2}.items():
        monkeypatch.setattr(hn, name, v)
    rows = clustered(2, 500)
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_a_third_of_all_rows_is_one_vector_and_scores_tie(spark):
    rows = clustered(3, 300) + [(1000 + i, i % 3, [1.0, 0.5, 0.0, 0.25, -1.0, 2.0]) for i in range(200)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(None, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (10, None, [1.0, 1.0]), (20, 1, None), (1, 1, [1.0, None]), (2, 1, [1.0, nan]), (3, 2, [inf, 1.0]), (4, 1, [1.0, 1.0]), (4, 1, [1.0, 1.0]), (5, 2, [1.0]), (6, 2, [0.5, 1.0]), (6, 2, [0.5, 1.0])]
    rows += [(7, 2, []), (30, 2, []), (40, 3, [-1.0, -1.0]), (0, 2, [1.0, 0.9]), (8, 3, [1e5, 1e5]), (9, 3, [3e7, 1.0]), (50, 3, [2e9, 2e9]), (11, 1, [2e9, 1.9e9]), (12, 3, [1.9e9, 2e9])]
    rows = [(i, l, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows]
    cap = [(a, p, r, n, min(s, hn._MAX), min(t, hn._MAX)) for a, p, r, n, s, t in brute(rows, lambda i: i % 10 == 0)]
    got = mined(spark, rows, x="clash", list="clash", anchor="clash")
    assert [g for g in got if g[0] != 50] == [c for c in cap if c[0] != 50] and got


def test_empty_tables_and_no_partners(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []


def test_products_are_exact():
    r = random.Random(0)
    for top in (200, 1 << 18, 1 << 30, 1 << 40):
        a, b = (np.array([[r.randint(-top, top) for _ in range(5)] for _ in range(9)], float) for _ in range(2))
        want = [[max(hn._MIN, min(hn._MAX, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert hn.exact_products(a, b).tolist() == want


def test_bounds_hold_and_skip_lists():
    """Every score lies within its list's bounds; on clustered vectors most lists are skipped, and none that holds a result."""
    x = np.floor(256 * np.array([v for _, _, v in clustered(4, 2000, dims=4, spread=0.02)]))
    centres = hn.fitted(x[::7], 40)
    own, far = hn._nearest(x, centres)
    radii = np.array([far[own == c].max(initial=0) for c in range(len(centres))])
    a, s = x[:50], x[:50] @ x.T
    low, high = hn.bounds(a, centres, radii)
    assert (low[:, own] <= s).all() and (s <= high[:, own]).all()
    kth = np.sort(s, 1)[:, -5:-4].astype(np.int64)
    one = np.ones_like(kth)
    go = hn.visits(a, centres, radii, hn._MIN * one, hn._MAX * one, kth, 0, 40)
    assert go.mean() < 0.3 and all(go[i, own[j]] for i, j in zip(*np.nonzero(s >= kth)))
    # a window far below an anchor's score with itself skips its own list
    top = (a * a).sum(1)[:, None].astype(np.int64) // 4
    go = hn.visits(a, centres, radii, hn._MIN * one, top, hn._MIN * one, 0, 40)
    assert not any(go[i, own[i]] for i in range(50)) and all(go[i, own[j]] for i, j in zip(*np.nonzero(s <= top)))


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    rows = [(i, (l + 1) % 10 if i % 7 == 0 and l is not None else l, v) for i, l, v in rows]
    assert sorted(tuple(r) for r in hn.op13_hard_negatives(spark, d).collect()) == brute(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("sizes", [{"CELL": 60, "ANCHORS": 20, "STEP": 6}, {"CELL": 16, "PART": 10, "BLOCK": 4, "ANCHORS": 9, "FIRST": 1, "WIDEN": 3}])
def test_groups_of_anchors_and_cells_of_rows(spark, monkeypatch, sizes):
    for name, v in sizes.items():
        monkeypatch.setattr(hn, name, v)
    # noise without clusters, and a list of equal rows that spans many cells
    rows = clustered(5, 400, spread=2.0) + [(1000 + i, i % 3, [1.0, 0.5, 0.0, 0.25, -1.0, 2.0]) for i in range(150)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_anchors_are_sent_by_cell_and_never_broadcast(spark, monkeypatch):
    """Copies of anchors, one for each list visited, were broadcast by the size of what they are made from."""
    plans = []
    monkeypatch.setattr(hn, "staged", lambda df, label, f=hn.staged: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if label == "best" else None) or f(df, label))
    mined(spark, clustered(6, 300))
    assert plans and all("CoGroup" in p and not any("x#" in line or "vectors#" in line for line in p.splitlines() if "BroadcastExchange" in line) for p in plans)
    for p in plans:
        # what is broadcast are pairs of a group and a list
        assert p.count("BroadcastExchange") <= 1
