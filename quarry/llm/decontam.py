"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts and items are normalised alike: A-Z become lower case and words are runs of
characters other than ASCII punctuation, spaces and controls. Each item gives the windows
of ``window`` consecutive words (a shorter item is one window). One scan of a normalised
text finds every window; the hits are mapped back to words and to code points of the
original text.

The automaton is broadcast and stays in each worker, so its source is measured first. Items of
over ``MAX_ITEM_BYTES`` of text in all are scanned in parts: long items are cut into pieces that
share ``window`` - 1 words, so that every window is in one piece, pieces are dealt out by hash,
and each part is one pass with an automaton of its own, whose runs of words are united with
those of the passes before. A worker keeps the automaton of one pass only.

Defined results: null and wordless texts have no words and are clean; items that are null
or wordless give no window, as do items with a null id; repeated items count once by id;
with an empty item table nothing is hit. Other columns pass through untouched.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ship, staged

#: Words in a window.
WINDOW = 13
#: Bytes of item text behind an automaton, whose states take some fifty times as much memory.
MAX_ITEM_BYTES = 8 << 20

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text; bytes over 127 belong to words."""
    return text.translate(_LOWER).split()


def windows_of(text: bytes, window: int = WINDOW) -> set[bytes]:
    w = words_of(text)
    return {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


def automaton(items: list[tuple[str, bytes]], window: int = WINDOW) -> ahocorasick.Automaton | None:
    """Values are (words in the window, the ids of the items that have it)."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows_of(text, window):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    a = ahocorasick.Automaton()
    for w, ids in owners.items():
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(ids))))
    a.make_automaton()
    return a


def scan(a: ahocorasick.Automaton | None, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
    """(words, merged runs [first word, past the last) that are hit, ids of the items with a window)."""
    w = words_of(text)
    if a is None or not w:
        return len(w), [], []
    joined = b" " + b" ".join(w) + b" "
    hits = list(a.iter(joined.decode("latin-1")))
    if not hits:
        return len(w), [], []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.searchsorted(spaces, [end for end, _ in hits])  # a hit ends on the space after its last word
    edges = np.zeros(len(w) + 1, np.int32)
    for end, (_, (n, _)) in zip(ends, hits, strict=True):
        edges[end - n] += 1
        edges[end] -= 1
    hit = np.concatenate(([0], np.cumsum(edges[:-1]) > 0, [0])).astype(np.int8)
    steps = np.flatnonzero(np.diff(hit))
    return len(w), list(zip(steps[::2].tolist(), steps[1::2].tolist(), strict=True)), sorted({i for _, (_, ids) in hits for i in ids})


def spans_of(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of words as code points [start, end) of the original text."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text.lower())]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[at[i][0]]), int(points[at[j - 1][1]])) for i, j in runs]


def pieces(text: bytes, window: int, most: int) -> list[bytes]:
    """The words of an item as texts of at most about ``most`` bytes each, which overlap by ``window`` - 1 words."""
    w = words_of(text)
    out, first, size = [], 0, 0
    for i, x in enumerate(w):
        size += len(x) + 1
        if size >= most and i + 1 - first >= window:
            out.append(b" ".join(w[first : i + 1]))
            first = i + 2 - window
            size = sum(len(y) + 1 for y in w[first : i + 1])
    # the rest adds windows only if it goes beyond what it shares
    if not out or len(w) - first >= window:
        out.append(b" ".join(w[first:]))
    return out


_HIT = "n_words long, runs array<struct<first:int,past:int>>, spans array<struct<start:int,end:int>>, items array<string>"
#: Each worker process builds an automaton once.
_built: dict[tuple[str, int], ahocorasick.Automaton | None] = {}


def _scanner(spark: SparkSession, items: list[tuple[str, bytes]], window: int) -> Callable[[Column], Column]:
    told, mark = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf(_HIT)
    def hits(texts: pd.Series) -> pd.DataFrame:
        key = (mark, window)
        if key not in _built:
            _built.clear()
            _built[key] = automaton(told.value, window)
        a = _built[key]
        rows = []
        for t in texts:
            t = b"" if t is None else bytes(t)
            n, runs, ids = scan(a, t)
            rows.append((n, [{"first": i, "past": j} for i, j in runs], [{"start": i, "end": j} for i, j in spans_of(t, runs)], ids))
        return pd.DataFrame(rows, columns=["n_words", "runs", "spans", "items"])

    return hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits", window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, items (ids as strings, sorted), spans (in code points), contaminated; a column of that name is replaced.

    A text is contaminated if any word is hit and a twentieth of its words or more are.
    """
    spark = docs.sparkSession
    ship(spark)
    b = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tmp, new = "__quarry_hits", "__quarry_part"
    if size <= max_item_bytes:
        df = docs.withColumn(tmp, _scanner(spark, _collected(b), window)(F.col(text).cast("binary")))
    else:
        df = docs
        for i, part in enumerate(_parts(b, window, size, max_item_bytes)):
            # staged, so that no worker holds two automata
            df = df.withColumn(new, _scanner(spark, _collected(part), window)(F.col(text).cast("binary")))
            df = staged(df.withColumn(tmp, _united(F.col(tmp), F.col(new)) if i else F.col(new)).drop(new), "part")
    h = F.col(tmp)
    n_hit = F.aggregate(h["runs"], F.lit(0).cast("long"), lambda s, r: s + r["past"] - r["first"])
    named = F.struct(h["n_words"].alias("n_words"), n_hit.alias("n_hit"), h["items"].alias("items"), h["spans"].alias("spans"), ((n_hit > 0) & (20 * n_hit >= h["n_words"])).alias("contaminated"))
    return df.select(*(F.col(f"`{c}`") for c in docs.columns if c != out), named.alias(out))


def _collected(items: DataFrame) -> list[tuple[str, bytes]]:
    return [(r["item"], bytes(r["text"])) for r in items.collect()]


def _parts(items: DataFrame, window: int, size: int, most: int) -> list[DataFrame]:
    """The items' pieces in parts of at most ``most`` bytes each."""

    def cut(batches):
        for b in batches:
            rows = [(i, n, p) for i, t in zip(b["item"], b["text"], strict=True) for n, p in enumerate(pieces(bytes(t), window, max(most // 16, 1)))]
            yield pd.DataFrame(rows, columns=["item", "n", "text"])

    p = staged(items.mapInPandas(cut, "item string, n int, text binary").where(F.octet_length("text") > 0), "pieces")
    parts = -(-size // most)
    while True:
        part = F.pmod(F.xxhash64("item", "n"), F.lit(parts))
        largest = p.groupBy(part.alias("part")).agg(F.sum(F.octet_length("text")).alias("size")).agg(F.max("size")).first()[0] or 0
        # parts even out as they get smaller; single words may be longer than a piece should be
        if largest <= most or parts > 64 * (size // most + 1):
            return [p.where(part == i).select("item", "text") for i in range(parts)]
        parts = parts * 3 // 2 + 1


def _united(a: Column, b: Column) -> Column:
    """Two passes' hits as one: runs of words and their spans merged where they meet, items together."""
    runs = lambda h: F.zip_with(h["runs"], h["spans"], lambda r, s: F.struct(r["first"].alias("first"), r["past"].alias("past"), s["start"].alias("start"), s["end"].alias("end")))

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["past"], x["past"]).alias("past"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (last["past"] >= x["first"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(x)))

    none = F.expr("CAST(array() AS array<struct<first:int,past:int,start:int,end:int>>)")
    merged = F.aggregate(F.array_sort(F.concat(runs(a), runs(b))), none, step)
    return F.transform(
        F.array(F.struct(merged.alias("m"))),
        lambda s: F.struct(
            a["n_words"].alias("n_words"), F.transform(s["m"], lambda r: F.struct(r["first"].alias("first"), r["past"].alias("past"))).alias("runs"),
            F.transform(s["m"], lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
        ),
    )[0]


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` against every item of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    h = F.col("hits")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
        h["contaminated"].alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = "__quarry_found"
    return decontaminate(docs, b, out=name).where(~F.col(name)["contaminated"]).drop(name)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i FROM d, lens WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
