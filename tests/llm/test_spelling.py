import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from quarry.llm import spelling as sp


def brute(rows, least=5, occurrences=3, ratio=2, one_in=97):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if one_in and i is not None and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= occurrences}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if v != w and apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n[w], len(near[w]), n[form[w]] if form[w] else -1))
    return sorted(out)


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_random_texts(spark):
    r = random.Random(3)
    stems = ["".join(r.choices("abé", k=r.randint(4, 8))) for _ in range(40)]
    rows = []
    for i in range(300):
        words = []
        for w in r.choices(stems, weights=[2.0**-k for k in range(40)], k=60):
            if r.random() < 0.3:
                p, c = r.randrange(len(w)), r.choice("abÉz")
                w = r.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :], w.upper()])
            words.append(w)
        rows.append((i, " ".join(words)))
    want = brute(rows)
    assert rows_of(sp.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), one_in=97)) == want
    assert sum(w[1] != "" for w in want) > 20 and any(w[1] and w[2] != w[1] for w in want)


def test_odd_rows(spark):
    long, same = "ab" * 20_000, "a" * 30_000
    rows = [(None, "hello hello hello"), (1, None), (2, ""), (3, "12 34 !"), (3, "hellos hellos hellos"), (3, "hellos hellos hellos"), (4, f"{long} {long}c {same} {same}a"), (5, f"{long} {long}c {same} {same}a"), (6, f"{long} {long}c {same} {same}a " + "hallo " * 9)]
    rows += [(7, "ÀÉÿ×÷Z " * 3 + "àÉÿ×÷z " * 3 + "ĀbcdeĀ " * 3), (8, "abcd abcd abcd")]
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], "doc_id long, text string, word string, wid string, part string, n int")
    assert rows_of(sp.spelling_variants(df, one_in=97)) == brute(rows)


def test_empty_table(spark):
    assert sp.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keys_are_those_of_the_shortened_strings():
    r = random.Random(1)
    words = ["".join(r.choices("abcÿ", k=r.randint(1, 9))) for _ in range(200)]
    of, kind, place, key = sp.deletion_keys(words)
    left = [words[o] if k == sp.WHOLE else words[o][:p] + words[o][p + 1 :] for o, k, p in zip(of, kind, place)]
    keys = {}
    for s, k, p, x in zip(left, kind, place, key.tolist()):
        keys.setdefault((s, p if k == sp.REPLACED else "any"), set()).add(x)
    assert all(len(v) == 1 for v in keys.values()) and len({min(v) for v in keys.values()}) == len(keys)


def test_colliding_keys_are_told_apart():
    pdf = pd.DataFrame({"key": 7, "kind": [sp.REPLACED] * 3 + [sp.WHOLE, sp.LONGER, sp.LONGER], "place": [0, 0, 0, -1, 0, 0], "word": ["xhouse", "yhouse", "zmouse", "train", "strain", "straits"], "n": [5, 4, 3, 2, 6, 7]})
    got = sorted(map(tuple, sp._near(pdf).to_numpy().tolist()))
    assert got == [("strain", 1, 2, "train"), ("train", 1, 6, "strain"), ("xhouse", 1, 4, "yhouse"), ("yhouse", 1, 5, "xhouse")]


def test_many_words_at_one_place(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xE0, 0x100)]]
    rows = [(i, " ".join(f"{c}ouse" for c in letters for _ in range(1 + (c == "h") * 5))) for i in range(4)]
    assert rows_of(sp.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, one_in=0)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(sp.op12_spelling_variants(spark, d)) == brute(rows)
    assert np.any([r[1] != "" for r in brute(rows)])
