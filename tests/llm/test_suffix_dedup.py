import hashlib
import random

import numpy as np
import pytest

from quarry.llm import suffixdedup as sd


def brute(rows, least=50):
    """(n_bytes, spans, kept) of each (id, text), from a dictionary of all windows."""
    rows = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < i:
                gone[p : p + least] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
        out.append((len(b), [(int(x), int(y)) for x, y in zip(edge[::2], edge[1::2])], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def compare(spark, rows, **more):
    schema = "doc_id long, text string" + "".join(f", {k} string" for k in more)
    df = spark.createDataFrame([(*r, *more.values()) for r in rows], schema)
    got = sorted((str(r["doc_id"]), r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in sd.repeated_spans(df).collect())
    want = sorted((str(r[0]), *b) for r, b in zip(rows, brute(rows)))
    assert got == want


def random_rows(seed, n, hold):
    r = random.Random(seed)
    shared = ["".join(r.choices("abé xyz", k=r.randint(30, 220))) for _ in range(hold)]
    rows = []
    for i in range(n):
        parts = [r.choice(shared)[r.randint(0, 20) :] if r.random() < 0.6 else "".join(r.choices("abcdefgh ", k=r.randint(0, 120))) for _ in range(r.randint(0, 6))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed, monkeypatch):
    compare(spark, random_rows(seed, 60, 6))


def test_small_blocks_buckets_and_hot_phrases(spark, monkeypatch):
    """The same with many blocks and buckets, hashing in short passes, short segments, and every shared phrase cut into windows."""
    for name, v in {"BLOCK": 700, "CHUNK": 64, "BUCKET": 900, "TRANSFORM": 300, "LONGEST": 9, "HOT": 3}.items():
        monkeypatch.setattr(sd, name, v)
    rows = random_rows(9, 80, 4)
    data = [(np.int64(i), t.encode()) for i, t in rows]
    # workers have their own copy of the module, so the stages are run here
    import pandas as pd

    first = {}
    for i, b in data:
        first.setdefault(b, i)
    blocks = pd.concat(list(sd._packed(iter([pd.DataFrame([(i, b) for b, i in first.items()], columns=["did", "data"])]))), ignore_index=True)
    blocks["block"] = range(len(blocks))
    assert len(blocks) > 5
    reports = pd.concat(list(sd._reports(7)(iter([blocks]))))
    flags = pd.concat([sd._shared((k,), g) for k, g in reports.groupby("bucket")])
    assert any(b"\x02" in f for f in flags["flags"])
    blocks["flags"] = [flags[flags["block"] == b].sort_values("bucket")[["bucket", "flags"]].to_dict("records") for b in blocks["block"]]
    sent = pd.concat(list(sd._sent(7)(iter([blocks]))))
    ranges = pd.concat([sd._decided((k,), g) for k, g in sent[sent["bucket"] >= 0].groupby("bucket")])
    places = sent[sent["bucket"] < 0].set_index("block")
    blocks["lens"], blocks["later"], blocks["ids"], blocks["base"] = (list(places.loc[blocks["block"], c]) for c in ("lens", "dids", "ids", "base"))
    blocks["ranges"] = [list(ranges[ranges["block"] == b]["ranges"]) for b in blocks["block"]]
    got = pd.concat(list(sd._cut_out(iter([blocks]))))
    want = {i: b for (i, _), b in zip(rows, brute(rows))}
    for r in got.itertuples():
        assert (r.n_bytes, [(s["start"], s["end"]) for s in r.spans], r.kept) == want[r.did]


def test_odd_rows(spark):
    a = "The quick brown fox jumps over the lazy dog, again and again, until it is tired. "
    rows = [(None, a), (3, None), (4, ""), (5, a * 3), (5, a * 3), (5, "x" + a), (6, a[:50]), (7, a[:49]), (8, "z" * 5000), (9, "z" * 4000 + "y"), (2, "z" * 60), (10, "é" * 40), (1, "é" * 30 + "ü"), (11, "n\0" * 60), (12, "\0n" * 60)]
    compare(spark, rows, did="clash", data="clash", block="clash", sha="clash")


def test_hot_group_of_copies_and_a_common_passage(spark):
    passage = "All rights reserved. Redistribution is permitted provided that the notice stays. "
    rows = [(i, "one text that very many rows repeat exactly, without any change at all") for i in range(300)]
    rows += [(1000 + i, f"{i} start {passage}{i * 7} end") for i in range(300)]
    compare(spark, rows)


def test_empty_table(spark):
    assert sd.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_order_and_common_prefixes_of_a_transform():
    r = random.Random(5)
    texts = ["".join(r.choices("ab", k=r.randint(1, 90))).encode() for _ in range(60)]
    lens = np.array([len(t) for t in texts])
    starts = np.append(0, np.cumsum(lens + 1))[:-1]
    sym = np.append(np.frombuffer(b"\0".join(texts), np.uint8).astype(np.int64) + 1, 0)
    sym[starts + lens] = 0
    left = np.repeat(starts + lens, lens + 1) - np.arange(len(sym))
    joined = b"\0".join(texts) + b"\0"
    suffix = lambda p: joined[p : p + left[p]]
    sa = sd.sorted_suffixes(sym, left)
    assert sa.tolist() == sorted((p for p in range(len(sym)) if left[p]), key=lambda p: (suffix(p), p))
    common = lambda x, y: next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
    assert sd.common_prefixes(sym, left, sa, 20).tolist() == [0, *(min(20, common(suffix(p), suffix(q))) for p, q in zip(sa, sa[1:]))]


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for (i, _), (n, s, k) in zip(rows, brute(rows)))
    got = sorted(tuple(r) for r in sd.op11_suffix_dedup(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want and sum(w[2] for w in want) > 0
