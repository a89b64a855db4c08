"""The randomness battery and its control, recomputed in plain Python; places in texts with very many matches."""

import math
import random
import re

from pyspark.sql import functions as F

from quarry.llm import secrets

ABC = [e[1] for e in secrets.ENCODINGS]
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
r = random.Random(11)
WORDS = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))).capitalize() if r.random() < 0.1 else "".join(r.choices("etaoinshrdlucmfwyp", weights=range(18, 0, -1), k=r.randint(2, 9))) for _ in range(400)]
prose = lambda n: " ".join(r.choices(WORDS, k=n))


def tail(z):
    return math.erfc(abs(z) / math.sqrt(2)) / 2


def p_under(shown, abc):
    v, k, n = [abc.index(c) for c in shown], len(abc), len(shown)
    x2 = k / n * sum(shown.count(c) ** 2 for c in set(shown)) - n
    df = k - 1
    z = ((max(x2, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_chi = tail(z) if z > 0 else 1 - tail(z)
    high = [x >= k / 2 for x in v]
    n1, n0 = sum(high), n - sum(high)
    mean = 2 * n1 * n0 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    p_runs = 2 * tail((runs - mean) / math.sqrt(var)) if n1 and n0 and var > 0 else 0.0
    mid = (k - 1) / 2
    corr = sum((a - mid) * (b - mid) for a, b in zip(v, v[1:], strict=False)) / sum((x - mid) ** 2 for x in v)
    return min(1.0, 3 * min(p_chi, p_runs, 2 * tail(corr * math.sqrt(n))))


def infer(run):
    body = run.rstrip("=")
    bare = re.sub("[-_]", "", body)
    whole = re.sub("[_=]", "/", body.replace("-", "+"))
    bare = bare if len(bare) >= 20 else body
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", bare):
        return 0, bare.lower(), bare
    if re.fullmatch("[A-Z2-7]+", bare):
        return 1, bare, bare
    if len(bare) >= 20 and re.fullmatch("[0-9a-z]+|[0-9A-Z]+", bare):
        return 2, bare.lower(), bare
    return (4 if len(bare) < len(body) and re.fullmatch("[0-9A-Za-z]+", bare) else 3), whole, bare


def p_of(enc, shown, bare):
    p = p_under(shown, ABC[min(enc, 3)])
    return max(p, p_under(bare, ABC[4])) if enc == 4 else p


def step_of(p):
    return min(120, math.floor(-math.log10(max(p, 1e-300)) * 10))


def cls_of(n):
    return min(20, max(0, math.floor(math.log2(n / 20) * 2)))


def brute(texts, fdr=secrets.FDR):
    """The places of reported runs in each text."""
    runs, null = [], []
    for i, t in enumerate(texts):
        own = []
        for m in RUN.finditer(t):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                enc, shown, bare = infer(m[0])
                own.append((i, m.start(), m.end(), enc, cls_of(len(shown)), step_of(p_of(enc, shown, bare))))
        rest = RUN.sub(" ", t)
        for enc, cls in {(e, x[4]) for x in own for e in range(5)}:
            folded = rest.lower() if enc in (0, 2) else rest.upper() if enc == 1 else rest
            s = "".join(c for c in folded if c in ABC[enc])
            size = math.ceil(20 * 2 ** (cls / 2))
            null += [(enc, cls, step_of(p_of(enc, s[j : j + size], s[j : j + size]))) for j in range(0, len(s) - size + 1, size)]
        runs += own
    out = set()
    for cls in {x[4] for x in runs}:
        p = {}
        for x in runs:
            if x[4] == cls:
                ref = [s for e, c, s in null if e == x[3] and c <= cls]
                p[x] = (1 + sum(s <= x[5] for s in ref)) / (1 + len(ref))
        ranked = sorted(p.values())
        cut = max((q for i, q in enumerate(ranked, 1) if q <= fdr * i / len(ranked)), default=None)
        out |= {x[:3] for x, q in p.items() if cut is not None and q <= cut}
    return sorted(out), sorted(x[3:] for x in runs)


def corpus():
    draw = lambda abc, n: "".join(r.choices(abc, k=n))
    keys = [draw(ABC[e], n) for e in (0, 1, 2, 3) for n in (20, 24, 32, 40, 64) for _ in range(3)] + ["-".join(draw(ABC[4], 6) for _ in range(5)) for _ in range(4)]
    plain = ["-".join(r.choices([w.lower() for w in WORDS], k=6)) + f"-{i}" for i in range(40)]
    return [f"{prose(300)} {k} {prose(50)}" for k in keys + plain] + ["", "no runs here"], [len(k) for k in keys]


def test_reported_runs_equal_brute_force(spark):
    texts, sizes = corpus()
    n_keys = len(sizes)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = secrets.scan(docs.withColumn("secrets", F.lit(1))).select("doc_id", F.col("secrets.all").alias("all")).collect()
    got = sorted((x.doc_id, s.start, s.end) for x in found for s in x["all"] if s.kind == "rand")
    steps = docs.select(F.explode(secrets.candidates(F.col("text"))).alias("c")).select("c.enc", "c.cls", "c.step").collect()
    want, judged = brute(texts)
    assert sorted(map(tuple, steps)) == judged
    # a pattern's span isn't repeated
    base = {(x.doc_id, s.start) for x in found for s in x["all"] if s.kind != "rand"}
    assert got == [w for w in want if (w[0], w[1]) not in base]
    hit = {g[0] for g in got} | {b[0] for b in base}
    # short keys in letters alone look much like words
    long = {i for i, n in enumerate(sizes) if n >= 32}
    assert len(hit & set(range(n_keys))) >= 0.7 * n_keys and len(hit & long) >= 0.85 * len(long), (len(hit & long), len(long))
    assert len(hit - set(range(n_keys))) <= 4


def test_without_ordinary_text_nothing_is_reported(spark):
    docs = spark.createDataFrame([(1, "q8Zr2LxV0bT7nKdY4mWcE1sHfJ6uPgA9"), (2, None), (2, None)], "doc_id long, text string")
    assert [list(x.secrets["all"]) for x in secrets.scan(docs).collect()] == [[], [], []]
    assert secrets.scan(docs.where("doc_id > 5")).count() == 0


def test_ordinary_text_is_that_of_every_text(spark):
    # no text with a key has prose; before, windows came from those alone, so nothing was reported
    key = "q8Zr2LxV0bT7nKdY4mWcE1sHfJ6uPgA9"
    texts = [key, *(prose(300) for _ in range(20)), f"{key[::-1]} {prose(2)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {x.doc_id: [(s.start, s.end, s.kind) for s in x.secrets["all"]] for x in secrets.scan(docs).collect()}
    assert found.pop(0) == [(0, 32, "rand")] and found.pop(21) == [(0, 32, "rand")] and not any(found.values())


def test_windows_in_turn_and_their_steps(spark):
    # all encodings and classes of several sizes; random symbols among prose, so that steps of all heights occur
    needed = {e: [0, 1, 3] for e in range(5)}
    texts = [" ".join(prose(30) if r.random() < 0.5 else "".join(r.choices(ABC[r.choice((0, 1, 3))], k=15)) for _ in range(20)) for _ in range(6)]
    want = []
    for t in texts:
        for e in needed:
            s = "".join(c for c in (t.lower() if e in (0, 2) else t.upper() if e == 1 else t) if c in ABC[e])
            sizes, at, i = [(c, math.ceil(20 * 2 ** (c / 2))) for c in needed[e]], 0, 0
            while at + sizes[i % 3][1] <= len(s):
                c, n = sizes[i % 3]
                want.append((e, c, step_of(p_of(e, s[at : at + n], s[at : at + n]))))
                at, i = at + n, i + 1
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    steps = lambda most: sorted(map(tuple, secrets.window_steps(df, secrets.ordinary(F.col("t"), None, needed), needed, dict.fromkeys(needed, most)).collect()))
    whole = steps(120)
    # tiny p-values are approximate
    clipped = lambda rows: sorted((e, c, min(s, 40)) for e, c, s in rows)
    assert clipped(whole) == clipped(want) and len({s for *_, s in whole}) > 20
    for most in (0, 5, 17, 40):
        assert steps(most) == sorted((e, c, s if s <= most else secrets.ABOVE) for e, c, s in whole)


def test_steps_guessed_too_low_are_counted_again():
    runs, few = [(3, 0, 30, 1)], [(3, 0, 10, 50), (3, 0, 60, 50)]
    asked = []

    def others(kinds, most):
        asked.append((kinds, most))
        return [(3, 0, s if s <= most[3] else secrets.ABOVE, n) for s, n in ((20, 900), (90, 100))]

    assert secrets._with_others(runs, few, others, {3: [0]}, 0.05) == [*few, (3, 0, 20, 900), (3, 0, secrets.ABOVE, 100)]
    # of all windows fewer than one in twenty reach the guess, so the run might be reported: counted to its own step
    assert asked == [({3: [0]}, {3: 10}), ({3: [0]}, {3: 30})]


def test_a_hundred_thousand_matches_in_one_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "é password: hunter22\n" * n)], "doc_id long, text string")
    x = secrets.scan(docs).select(F.size("secrets.all").alias("n"), F.element_at("secrets.all", -1).alias("last")).first()
    assert (x.n, x.last.start, x.last.end) == (n, 21 * (n - 1) + 2, 21 * (n - 1) + 20)
