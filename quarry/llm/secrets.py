"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Patterns give spans of kinds ``assign``, ``access`` and ``hex`` (see ``PATTERNS``). The
battery takes the maximal runs of ``[A-Za-z0-9+/_=-]`` of ``MIN_RUN`` characters or more that
hold a digit and a letter, infers an encoding from their alphabet (hex, base32, base36 of either
case, base62 in groups, or base64; ``-`` and ``_`` are left out as separators where ``MIN_RUN``
characters remain without them, save in base64) and tests each against uniform random symbols:
chi-squared over the alphabet, runs above and below its middle, and lag-1 serial correlation,
combined by Bonferroni. The result, as a step of a fixed grid (0 for 1, rising as it falls),
says how little a run looks random.

What is reported is controlled against ordinary text: every text, its runs taken out, is cut
into windows of each encoding that some candidate has, of its own candidates' length classes or,
in a text without candidates, of all candidates' classes in turn. The battery's steps of all
these windows are the null distribution. A run's p-value is the share of windows
of its encoding, of its length class and shorter ones (which look no less random), whose step
is no higher; within each length class the Benjamini-Hochberg rule at level ``FDR`` decides
which runs are spans of kind ``rand``. So of those reported, about that share at most is
ordinary text. Without windows to compare with, nothing is reported. Spans that meet a
pattern's span aren't repeated.

Native DataFrame expressions throughout: two passes over the texts, of which the first one's finds
are staged; nothing is shuffled but the few texts with candidates and counts by encoding, class
and step, a bounded table.

Defined results: null text is empty; texts without spans have empty strings; equal texts
have equal spans within a table; repeated rows give a row each; offsets are code points
with the end exclusive, and other columns pass through untouched, but for one named as the
result, which is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import bound, located
from quarry.llm.common import staged

#: Fixed patterns by kind: (kind, regular expression, group whose length counts, least length).
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
MIN_RUN = 20
#: Expected share of ordinary text among the runs reported, within a length class.
FDR = 0.05
#: Steps of the p-value grid in each decade, and decades.
GRID, DECADES = 10, 12

#: Length classes: half octaves from MIN_RUN.
CLASSES = 21
#: The step of windows that are only known to lie above what is asked for.
ABOVE = GRID * DECADES + 1
#: Letters of which much ordinary text consists. Any others give the same results, later.
_FREQUENT = "etaoinsrhldumcgpfbyvkwqxjz"

_HEX, _B32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_B36 = "0123456789abcdefghijklmnopqrstuvwxyz"
_B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# the characters in full, not as ranges: Java looks single ones up in a table
_RUN = "[%s_=-]{%d,}" % (_B64, MIN_RUN)


def pattern_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    kept = F.filter(located(text, pattern), lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least)
    order = [p[0] for p in PATTERNS].index(kind)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def normal_tail(z: Column) -> Column:
    """P(Z > |z|) of a standard normal variable; a rational approximation good to 1e-7."""

    def tail(x: Column) -> Column:
        a, t = x["a"], x["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2) * 0.3989422804014327 * poly

    # values used more than once are bound, as expressions within lambdas are evaluated wherever they stand
    return bound(bound(F.abs(z), lambda a: F.struct(a.alias("a"), (1 / (1 + 0.2316419 * a)).alias("t"))), tail)


#: Encodings: name and alphabet.
ENCODINGS = (("hex", _HEX), ("base32", _B32), ("base36", _B36), ("base64", _B64), ("base62", _B62))


def inferred(run: Column) -> Column:
    """struct of enc (its place in ``ENCODINGS``), shown (the symbols to test) and bare (those without separators)."""
    body = F.regexp_replace(run, "=+$", "")
    bare = F.regexp_replace(body, "[-_]", "")
    whole = F.regexp_replace(F.regexp_replace(body, "-", "+"), "[_=]", "/")
    # separators count as such only if what is between them is long enough for a run
    bare = F.when(F.length(bare) >= MIN_RUN, bare).otherwise(body)
    is_hex, is_b32 = bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), bare.rlike("^[A-Z2-7]+$")
    is_b36 = (F.length(bare) >= MIN_RUN) & bare.rlike("^([0-9a-z]+|[0-9A-Z]+)$")
    # a mixed-case run with separators is either base64url or base62 in groups
    grouped = (F.length(bare) < F.length(body)) & bare.rlike("^[0-9A-Za-z]+$")
    enc = F.when(is_hex, 0).when(is_b32, 1).when(is_b36, 2).when(grouped, 4).otherwise(3)
    shown = F.when(is_b32 & ~is_hex, bare).when(is_hex | is_b36, F.lower(bare)).otherwise(whole)
    return F.struct(enc.alias("enc"), shown.alias("shown"), bare.alias("bare"))


def battery(enc: Column, shown: Column, bare: Column) -> Column:
    """The combined p-value of symbols under uniform random ones of their encoding; for base62 in groups the better of two."""
    alphabet = F.when(enc == 0, _HEX).when(enc == 1, _B32).when(enc == 2, _B36).otherwise(_B64)
    return F.greatest(_p_under(shown, alphabet), F.when(enc == 4, _p_under(bare, F.lit(_B62))))


def _p_under(shown: Column, alphabet: Column) -> Column:
    made = F.struct(F.length(alphabet).cast("double").alias("k"), F.filter(F.split(shown, ""), lambda c: c != "").alias("cs"), alphabet.alias("abc"), shown.alias("shown"))
    return bound(made, _p_of)


def _p_of(s: Column) -> Column:
    k, cs, abc = s["k"], s["cs"], s["abc"]
    v = F.transform(cs, lambda c: F.call_function("instr", abc, c).cast("double") - 1)
    # the count of a symbol is what the text loses without it
    count = lambda c: (F.size(cs) - F.length(F.replace(s["shown"], c, F.lit("")))).cast("double")
    squares = F.aggregate(F.array_distinct(cs), F.lit(0.0), lambda a, c: a + F.pow(count(c), F.lit(2.0)))
    return bound(bound(F.struct(k.alias("k"), F.size(cs).cast("double").alias("n"), v.alias("v"), squares.alias("squares")), _sums), _tests)


def _sums(s: Column) -> Column:
    """What the tests need, each computed once: k, n, sum of squared counts, symbols in the upper half, runs, products of neighbours, squares of deviations."""
    k, v = s["k"], s["v"]
    zero, mid = F.lit(0.0), (s["k"] - 1) / 2
    neighbours = lambda x, f: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), f)
    total = lambda x, start=0.0: F.aggregate(x, F.lit(start), lambda a, y: a + y)
    halves = bound(F.transform(v, lambda x: (x >= k / 2).cast("double")), lambda h: F.struct(total(h).alias("upper"), total(neighbours(h, lambda a, b: F.abs(a - b)), 1.0).alias("runs")))
    products = total(neighbours(v, lambda a, b: (a - mid) * (b - mid)))
    power = F.aggregate(v, zero, lambda a, x: a + (x - mid) * (x - mid))
    return F.struct(k.alias("k"), s["n"].alias("n"), s["squares"].alias("squares"), halves.alias("halves"), products.alias("products"), power.alias("power"))


def _tests(s: Column) -> Column:
    k, n, n1 = s["k"], s["n"], s["halves"]["upper"]
    # chi-squared by Wilson and Hilferty's cube root
    df = k - 1
    x2 = k / n * s["squares"] - n
    z_chi = (F.cbrt(F.greatest(x2, F.lit(1e-9)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p_chi = bound(z_chi, lambda z: bound(normal_tail(z), lambda p: F.when(z > 0, p).otherwise(1 - p)))
    # runs above and below the middle of the alphabet
    n0 = n - n1
    mean = 2 * n1 * n0 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when((n1 > 0) & (n0 > 0) & (var > 0), 2 * normal_tail((s["halves"]["runs"] - mean) / F.sqrt(var))).otherwise(F.lit(0.0))
    # lag-1 serial correlation about the alphabet's mean
    p_corr = 2 * normal_tail(s["products"] / s["power"] * F.sqrt(n))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_corr))


def _grid(p: Column) -> Column:
    """The step of the p-value grid, 0 for 1 and rising as p falls; it rounds p up."""
    return F.least(F.lit(GRID * DECADES), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * GRID)).cast("int")


def _class(n: Column) -> Column:
    """The length class of ``n`` symbols."""
    return F.least(F.lit(CLASSES - 1), F.greatest(F.lit(0), F.floor(F.log2(n / F.lit(float(MIN_RUN))) * 2))).cast("int")


def _is_candidate(run: Column) -> Column:
    return run.rlike("[0-9]") & run.rlike("[A-Za-z]")


def _any_candidate(text: Column) -> Column:
    return F.exists(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), _is_candidate)


def candidates(text: Column) -> Column:
    """array<struct<start, end, enc, cls, step>> of the runs that the battery judges."""
    found = F.filter(located(text, _RUN), lambda x: _is_candidate(x["m"]))
    kinds = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), inferred(x["m"]).alias("i")))

    def judged(x: Column) -> Column:
        i = x["i"]
        step = _grid(battery(i["enc"], i["shown"], i["bare"]))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), i["enc"].alias("enc"), _class(F.length(i["shown"])).alias("cls"), step.alias("step"))

    return F.transform(kinds, judged)


def _size(cls: int) -> int:
    """The symbols of a window of a length class."""
    return math.ceil(MIN_RUN * 2 ** (cls / 2))


def ordinary(rest: Column, own: Column | None, needed: dict[int, list[int]]) -> Column:
    """array<struct<enc, cls, w>> of the windows of a text without its runs.

    ``needed`` has the encodings with candidates in any text, and the classes to compare them with.
    A text with candidates is cut into windows of each of their classes, ``own``; one without (``own``
    not given) into windows of all needed classes in turn. What is too short for the next is left over.
    """
    item = lambda e, c, w: F.struct(F.lit(e).alias("enc"), c.cast("int").alias("cls"), w.alias("w"))

    def alike(enc: int, symbols: Column) -> Column:
        size = lambda c: F.ceil(MIN_RUN * F.pow(F.lit(2.0), c / 2)).cast("string")
        cut = lambda c: F.regexp_extract_all(symbols, F.concat(F.lit(".{"), size(c), F.lit("}")), F.lit(0))
        return F.flatten(F.transform(F.filter(own, lambda c: c <= needed[enc][-1]), lambda c: F.transform(cut(c), lambda w: item(enc, c, w))))

    def in_turn(enc: int, symbols: Column) -> Column:
        ends = list(accumulate(map(_size, needed[enc])))
        rounds = F.regexp_extract_all(symbols, F.lit(".{1,%d}" % ends[-1]), F.lit(0))
        one = lambda r: F.array(*(F.when(F.length(r) >= end, item(enc, F.lit(c), F.substring(r, end - _size(c) + 1, _size(c)))) for c, end in zip(needed[enc], ends, strict=True)))
        return F.filter(F.flatten(F.transform(rounds, one)), lambda x: x.isNotNull())

    def of(enc: int, t: Column) -> Column:
        folded = F.lower(t) if enc in (0, 2) else F.upper(t) if enc == 1 else t
        # in full as well
        return bound(F.regexp_replace(folded, f"[^{ENCODINGS[enc][1]}]+", ""), lambda x: in_turn(enc, x) if own is None else alike(enc, x))

    return bound(rest, lambda t: F.concat(*(of(e, t) for e in sorted(needed))))


def _too_many(k: int, n: int, most: int) -> int:
    """A sum of squared counts of ``n`` symbols from which on the chi-squared test alone puts the step above ``most`` (by one more, for rounding)."""

    def step(squares: int) -> float:
        df = k - 1
        z = ((max(k / n * squares - n, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        a, t = abs(z), 1 / (1 + 0.2316419 * abs(z))
        tail = math.exp(-a * a / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return -math.log10(max(min(1.0, 3 * (tail if z > 0 else 1 - tail)), 1e-300)) * GRID

    if most >= GRID * DECADES:  # where the grid ends, no step is above
        return n * n + 1
    low, high = 0, n * n + 1
    while high - low > 1:  # the step rises with the sum
        mid = (low + high) // 2
        low, high = (low, mid) if step(mid) > most + 2 else (mid, high)
    return high


def window_steps(texts: DataFrame, windows: Column, needed: dict[int, list[int]], most: dict[int, int]) -> DataFrame:
    """enc, cls, step of the windows of ``texts``; of steps above the encoding's ``most`` it is only told that they are.

    Where the counts of the most frequent letters, or of all, put a window there already, it is tested no further.
    """
    limits = [0] * (len(ENCODINGS) * CLASSES)
    for e, classes in needed.items():
        for c in classes:
            limits[e * CLASSES + c] = max(_too_many(k, _size(c), most[e]) for k in ((len(ENCODINGS[e][1]), 64) if e == 4 else (len(ENCODINGS[e][1]),)))
    # outer, as a filter inferred from an inner one would make the windows again
    x = texts.select(F.explode_outer(windows).alias("x")).where(F.col("x").isNotNull()).select("x.*")
    x = x.withColumn("t", F.when(F.col("enc") == 1, F.lower("w")).otherwise(F.col("w")))
    # squared counts of some letters; every other symbol adds one at least
    count = lambda c: F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))
    more = lambda start, letters: reduce(lambda a, c: a + c * (c - 1), map(count, letters), start)
    x = x.withColumn("least", more(F.length("t"), _FREQUENT[:12]))
    limit = F.element_at(F.lit(limits), F.col("enc") * CLASSES + F.col("cls") + 1)
    tested = _grid(battery(F.col("enc"), F.col("w"), F.col("w")))
    step = F.when(F.col("least") >= limit, ABOVE).when(more(F.col("least"), _FREQUENT[12:]) >= limit, ABOVE).otherwise(tested)
    most_of = F.element_at(F.lit([most.get(e, 0) for e in range(len(ENCODINGS))]), F.col("enc") + 1)
    return x.select("enc", "cls", step.alias("step"), most_of.alias("most")).select("enc", "cls", F.when(F.col("step") > F.col("most"), ABOVE).otherwise(F.col("step")).alias("step"))


def _p_value(null: Iterable[tuple[int, int, int, int]], enc: int, cls: int, step: int) -> float:
    own = [(s, n) for e, c, s, n in null if e == enc and c <= cls]
    return (1 + sum(n for s, n in own if s <= step)) / (1 + sum(n for _, n in own))


def thresholds(runs: Iterable[tuple[int, int, int, int]], null: Iterable[tuple[int, int, int, int]], fdr: float = FDR) -> dict[tuple[int, int], int]:
    """By (encoding, class), the highest step at which a run is reported; both inputs are counts (enc, cls, step, n)."""
    runs, null = list(runs), list(null)

    out: dict[tuple[int, int], int] = {}
    for cls in {r[1] for r in runs}:
        own = sorted((_p_value(null, e, c, s), e, s, n) for e, c, s, n in runs if c == cls)
        total, seen, cut = sum(n for *_, n in own), 0, None
        for i, (p, _, _, n) in enumerate(own):
            seen += n
            if (i + 1 == len(own) or own[i + 1][0] > p) and p <= fdr * seen / total:
                cut = p
        for p, e, s, _ in own:
            if cut is not None and p <= cut:
                out[e, cls] = max(out.get((e, cls), -1), s)
    return out


def _with_others(runs: list[tuple], few: list[tuple], others: Callable, needed: dict[int, list[int]], fdr: float) -> list[tuple]:
    """``few``, the counts of windows of the texts with candidates, and those of all other texts.

    A run whose p-value is over ``fdr`` isn't reported, so steps that more windows than that reach
    needn't be told apart. How far they must be is guessed from ``few``; an encoding whose windows
    turn out to be others is counted again, as far as any run's step.
    """
    most = {}
    for e in needed:
        own = sorted((s, n) for k, _, s, n in few if k == e)
        total, seen = sum(n for _, n in own), accumulate(n for _, n in own)
        guess = next((s for (s, _), n in zip(own, seen, strict=True) if n >= 2 * fdr * total), ABOVE - 1)
        most[e] = min(guess, max(s for k, _, s, _ in runs if k == e))
    out = few + others(needed, most)
    wrong = {e for e, c, s, _ in runs if s > most[e] and _p_value(out, e, c, s) <= fdr}
    if wrong:
        again = {e: max(s for k, _, s, _ in runs if k == e) for e in wrong}
        out = few + [x for x in out[len(few) :] if x[0] not in wrong] + others({e: needed[e] for e in wrong}, again)
    return out


_SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def scan(df: DataFrame, text: str = "text", out: str = "secrets", fdr: float = FDR, keep_text: bool = True) -> DataFrame:
    """``df`` (without ``keep_text``, less its text) with a struct ``out``: base and all, arrays of struct<start, ord, end, kind> ordered by start, then kind."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.array_sort(F.concat(*(pattern_spans(t, *p) for p in PATTERNS)))
    b, c, o = "__quarry_base", "__quarry_cand", "__quarry_rest"
    names = [n for n in df.columns if n != out and (keep_text or n != text)]
    kept = [F.col(f"`{n}`") for n in names]
    found = df.select(*kept, t.alias("__quarry_text"), base.cast(_SPAN).alias(b), candidates(t).alias(c))
    # what a first pass finds is staged, with the few texts that hold a candidate
    rest = F.when(F.size(c) > 0, F.regexp_replace("__quarry_text", _RUN, " "))
    found = staged(found.select(*kept, b, c, rest.alias(o)), "secrets")
    counts = lambda df: [tuple(r) for r in df.groupBy("enc", "cls", "step").count().collect()]
    runs = counts(found.select(F.explode(c).alias("r")).select("r.*"))
    classes = sorted({r[1] for r in runs})
    last = {e: max(r[1] for r in runs if r[0] == e) for e in {r[0] for r in runs}}
    needed = {e: [k for k in classes if k <= most] for e, most in last.items()}
    null = []
    if needed:
        few = found.where(F.col(o).isNotNull()).repartition(found.sparkSession.sparkContext.defaultParallelism * 4)
        own = F.array_distinct(F.transform(c, lambda x: x["cls"]))
        null = counts(window_steps(few, ordinary(F.col(o), own, needed), needed, dict.fromkeys(needed, ABOVE - 1)))
        # all other texts are read again
        other = df.select(t.alias(o)).where(~_any_candidate(F.col(o))).select(F.regexp_replace(o, _RUN, " ").alias(o))
        null = _with_others(runs, null, lambda kinds, most: counts(window_steps(other, ordinary(F.col(o), None, kinds), kinds, most)), needed, fdr)
    limits = thresholds(runs, null, fdr)
    flat = [F.lit(x) for (e, k), s in sorted(limits.items()) for x in (e * CLASSES + k, s)]
    table = F.create_map(*flat) if flat else F.expr("map(-1, 0)")
    rand = F.filter(F.col(c), lambda x: (x["step"] <= F.coalesce(F.try_element_at(table, x["enc"] * CLASSES + x["cls"]), F.lit(-1))) & ~F.exists(F.col(b), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    more = F.transform(rand, lambda x: F.struct(x["start"].alias("start"), F.lit(len(PATTERNS)).alias("ord"), x["end"].alias("end"), F.lit("rand").alias("kind")))
    both = F.array_sort(F.concat(F.col(b), more.cast(_SPAN)))
    return found.select(*kept, F.struct(F.col(b).alias("base"), both.alias("all")).alias(out))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span (ordered, possibly overlapping) replaced by ``mask``."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        new = F.when(x["start"] >= a["at"], F.concat(a["out"], gap, F.lit(mask))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), new.alias("out"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = F.col("secrets")
    n = lambda kind: F.size(F.filter(s["base"], lambda x: x["kind"] == kind)).cast("long")
    return scan(docs, keep_text=False).select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(s["base"]), 256).alias("base_sha256"),
        joined(s["all"]).alias("spans"),
    )
