"""Language identification by mixtures: which languages a text holds, and in which proportions.

Each language has log-probabilities of hashed byte trigrams, learned from labelled rows. A
text is cut into units of ``UNIT`` bytes; expectation-maximisation over the units estimates
the proportions of all languages, and then of the best one, two, ... of them. The number of
languages kept has the best likelihood less a penalty of half the logarithm of the units for
each further language. The prediction is the language with the largest proportion.

Learning takes about ``SAMPLE_ROWS`` rows, chosen by a hash of the id among the rows not
held out, with their whole texts; all else covers every row.

Defined results: null text and text without a letter give ``und`` and score 0, as does
every text if no labelled row could be learned from; a text of one letter gets the language
of the best prior and likelihood; repeated rows give a row each and equal texts equal
results; ties go to the language first in order; other columns pass through untouched, but
for one named as the result, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import held_out, ship

#: About so many labelled rows are learned from.
SAMPLE_ROWS = 20_000
#: Hashed trigrams, bytes in a unit, rounds of expectation-maximisation.
BUCKETS, UNIT, ROUNDS = 1 << 16, 32, 12
#: A unit's trigrams overlap, so its log-likelihood is divided by this.
TEMPER = 3.0
UND = "und"
#: Bytes of text scored at once.
BLOCK = 2 << 20

_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore")))


def codes(data: bytes) -> np.ndarray:
    """The hashed trigram that begins at each byte; ``BUCKETS`` where the unit's padding is met."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = b.copy()
    h[:-1] += b[1:] << 8
    h[:-2] += b[2:] << 16
    h *= np.uint32(2654435761)
    h >>= np.uint32(16)
    zero = b == 0
    pad = zero.copy()
    pad[:-1] |= zero[1:]
    pad[:-2] |= zero[2:]
    pad[-2:] = True
    h[pad] = BUCKETS
    return h


def _units(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The folded texts, each between spaces and padded with zeros to whole units, joined; and each one's units."""
    parts, n = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        t = b" " + b" ".join(t.translate(_FOLD).split()) + b" "
        n[i] = -(-(len(t) + 2) // UNIT)  # with two zeros at least, no trigram reaches into the next text
        parts.append(t.ljust(int(n[i]) * UNIT, b"\0"))
    return b"".join(parts), n


def counts(texts: list[bytes]) -> np.ndarray:
    data, _ = _units(texts)
    return np.bincount(codes(data), minlength=BUCKETS + 1)[:BUCKETS]


class Model:
    """Languages, and their tempered log-probabilities by trigram (with a last row of zeros for padding)."""

    def __init__(self, langs: list[str], counted: np.ndarray):
        self.langs = langs
        p = (counted + 0.1) / (counted.sum(1, keepdims=True) + 0.1 * BUCKETS)
        self.table = np.zeros((BUCKETS + 1, len(langs)), np.float32)
        self.table[:BUCKETS] = np.log(p).T / TEMPER

    def proportions(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages: proportions in the selected set; languages in the set)."""
        data, n = _units(texts)
        ll = self.table[codes(data)].reshape(-1, UNIT, len(self.langs)).sum(1, dtype=np.float64)
        top = ll.max(1, keepdims=True)
        like, starts, owner = np.exp(ll - top), np.concatenate(([0], np.cumsum(n)[:-1])), np.repeat(np.arange(len(n)), n)

        def fit(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                r = like * pi[owner]
                r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
                pi = np.add.reduceat(r, starts, axis=0) / n[:, None]
            mixed = np.log(np.maximum((like * pi[owner]).sum(1), 1e-300))
            return pi, np.add.reduceat(mixed, starts)

        k = len(self.langs)
        full, whole = fit(np.full((len(n), k), 1 / k), ROUNDS)
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        best = np.full(len(n), -np.inf)
        out, size = np.zeros_like(full), np.zeros(len(n), np.int64)
        for m in range(1, k + 1):
            start = np.where(rank < m, np.maximum(full, 1e-6), 0)
            pi, value = fit(start / start.sum(1, keepdims=True), ROUNDS // 2 if 1 < m < k else 0)
            value = value - (m - 1) * 0.5 * np.log(np.maximum(n, 2)) - (m - 1)
            better = value > best
            best, out, size = np.where(better, value, best), np.where(better[:, None], pi, out), np.where(better, m, size)
        return out, size


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from rows that aren't held out and have a language and a text; None if there are none."""
    ship(docs.sparkSession)
    rows = docs.where(~held_out(key) & F.col(lang).isNotNull() & (F.col(lang) != UND))
    n = rows.count()
    if not n:
        return None
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(10)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, g in b.groupby("lang"):
                total[name] = total.get(name, 0) + counts([bytes(t) for t in g["text"]])
        yield pd.DataFrame({"lang": pd.Series(list(total), dtype=object), "counts": pd.Series([c.astype("<i8").tobytes() for c in total.values()], dtype=object)})

    # a bounded sample, so few tasks; each sends one row of counts for each language
    picked = rows.where(F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    found: dict[str, np.ndarray] = {}
    for r in picked.repartition(6).mapInPandas(tally, "lang string, counts binary").collect():
        found[r["lang"]] = found.get(r["lang"], 0) + np.frombuffer(bytes(r["counts"]), "<i8")
    langs = sorted(k for k, c in found.items() if c.sum())
    return Model(langs, np.array([found[k] for k in langs], np.float64)) if langs else None


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out``: lang_pred, score (its proportion), languages (the set, most first, comma-joined)."""
    if model is None:
        return docs.withColumn(out, F.struct(F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit("").alias("languages")))
    ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, languages string")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = told.value
        data = [b"" if t is None else bytes(t) for t in texts]
        rows: list[tuple[str, float, str]] = [(UND, 0.0, "")] * len(data)
        todo, size = [], 0
        for i, t in enumerate([*data, None]):
            if todo and (t is None or size + len(t) > BLOCK):
                pi, kept = m.proportions([data[j] for j in todo])
                order = np.argsort(-pi, axis=1, kind="stable")
                for j, p, o, k in zip(todo, pi, order, kept, strict=True):
                    rows[j] = (m.langs[o[0]], float(min(1.0, p[o[0]])), ",".join(m.langs[x] for x in o[:k]))
                todo, size = [], 0
            if t is not None and has_letter(t):
                todo.append(i)
                size += len(t)
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    return docs.withColumn(out, predict(F.col(text).cast("binary")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    r = F.col("language")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), r["lang_pred"].alias("lang_pred"), r["score"].alias("score"), r["languages"].alias("languages"))
