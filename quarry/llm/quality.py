"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are cut into bins at quantiles of the sample. Cyclic boosting visits
the features in turn and adds a shallow tree on that feature's bins, shrunk by ``RATE``, to
its lookup table; then the pairs with the largest remaining gain get tables of their own in
the same way. A text's score is the logistic of the sum of its bins' entries.

Learning takes about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the id among the
rows not held out; features and scores cover every row.

Defined results: null and empty texts have features of zero and are scored like any other;
null labels are ignored, and repeated labels of a document count each; with no labels the
score is 0.5, with labels of one kind it is the smoothed share of ones; other columns pass
through untouched, but for one named as the result, which is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import held_out, ship

#: About so many labelled rows are learned from.
SAMPLE_ROWS = 12_000
#: Bins of a feature, and of each side of a pair.
BINS, PAIR_BINS = 32, 8
#: Boosting: rounds over the features, rounds over the pairs, shrinkage, leaf regularisation, pairs kept.
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, PAIRS = 60, 30, 0.2, 2.0, 6
#: A text is good from this score on.
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_length", "long_words", "distinct_words", "repeated_neighbour", "top_word", "upper", "digits", "symbols",
    "full_stops", "exclaims", "bars", "non_ascii", "log_lines", "distinct_lines", "line_length", "words_capital", "bare_words", "entropy",
)

_ALNUM = bytes(x if x >= 128 or 48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122 else 32 for x in range(256))
_KIND = np.zeros(256, np.int64)  # 0 letters and over 127, 1 capitals, 2 digits, 3 white space, 4 stops and commas, 5 other symbols
_KIND[:128] = 5
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[48:58] = 2
_KIND[65:91] = 1
_KIND[97:123] = 0
_KIND[[33, 39, 40, 41, 44, 46, 58, 59, 63]] = 4
_CAPITAL = re.compile(rb"(?<![A-Za-z\x80-\xff])[A-Z]")


def features(text: bytes) -> list[float]:
    """The values of ``FEATURES`` for a whole UTF-8 text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=b, minlength=6)
    words = text.translate(_ALNUM).lower().split()
    w = max(1, len(words))
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = b[b > 0] / n
    pieces = len(text.split())
    return [
        np.log1p(n),
        np.log1p(len(words)),
        (n - kind[3] - kind[4] - kind[5]) / w,
        sum(c for x, c in seen.items() if len(x) > 15) / w,
        len(seen) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        max(seen.values(), default=0) / w,
        kind[1] / n,
        kind[2] / n,
        kind[5] / n,
        b[46] / w,
        b[33] / w,
        b[124] / w,
        b[128:].sum() / n,
        np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        len(_CAPITAL.findall(text)) / w,
        len(words) / max(1, pieces),
        float(-(p * np.log2(p)).sum()),
    ]


def _step_values(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of ``depth`` levels on ordered bins: its value in each bin, from sums of gradients and hessians."""
    out = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth == 0 or len(g) < 2:
        return out
    cg, ch = np.cumsum(g), np.cumsum(h)
    gain = cg[:-1] ** 2 / (ch[:-1] + RIDGE) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + RIDGE)
    gain[(ch[:-1] < 1) | (ch[-1] - ch[:-1] < 1)] = -1
    at = int(np.argmax(gain)) + 1
    if gain[at - 1] <= cg[-1] ** 2 / (ch[-1] + RIDGE) + 1e-9:
        return out
    return np.concatenate((_step_values(g[:at], h[:at], depth - 1), _step_values(g[at:], h[at:], depth - 1)))


def _pair_values(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of two levels on a grid of bins, first along one side and then the other: (values, gain)."""
    best = np.full(g.shape, 0.0), 0.0
    base = g.sum() ** 2 / (h.sum() + RIDGE)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for at in range(1, a.shape[0]):
            v, gain = np.empty(a.shape), -base
            for part in (slice(0, at), slice(at, None)):
                pg, ph = a[part].sum(0), b[part].sum(0)
                row = _step_values(pg, ph, 1)
                v[part] = row
                cut = np.flatnonzero(np.diff(row)) + 1
                gain += sum(x.sum() ** 2 / (y.sum() + RIDGE) for x, y in zip(np.split(pg, cut), np.split(ph, cut), strict=True))
            if gain > best[1] + 1e-9:
                best = (v.T.copy() if flip else v), gain
    return best


class Model:
    """Bin edges, and lookup tables by feature and by pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, k = x.shape
        share = (y.sum() + 1) / (n + 2)
        self.bias = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for f in range(k)]
        self.coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if n else np.empty(0) for f in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        if not n or not 0 < y.sum() < n:
            return
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        z = np.full(n, self.bias)
        for _ in range(ROUNDS):
            for f in range(k):
                g, h = self._gradients(y, z)
                m = len(self.tables[f])
                step = RATE * _step_values(np.bincount(bins[f], g, m), np.bincount(bins[f], h, m))
                self.tables[f] += step
                z += step[bins[f]]
        low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]

        def grid(f: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            shape = len(self.coarse[f]) + 1, len(self.coarse[j]) + 1
            cell = low[f] * shape[1] + low[j]
            g, h = self._gradients(y, z)
            return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

        gains = {(f, j): _pair_values(*grid(f, j)[1:])[1] for f in range(k) for j in range(f)}
        for f, j in sorted(gains, key=lambda q: (-gains[q], q))[:PAIRS]:
            self.pairs[f, j] = np.zeros((len(self.coarse[f]) + 1, len(self.coarse[j]) + 1))
        for _ in range(PAIR_ROUNDS):
            for f, j in self.pairs:
                cell, g, h = grid(f, j)
                step = RATE * _pair_values(g, h)[0]
                self.pairs[f, j] += step
                z += step.ravel()[cell]

    @staticmethod
    def _gradients(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for (f, j), t in self.pairs.items():
            z += t[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-z))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(b"" if t is None else bytes(t)) for t in texts])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``label`` (0 or 1) by the texts of rows that aren't held out."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").alias(key), F.col(label).cast("int").alias("__quarry_y"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64(F.col(key), F.lit(4)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    # the sample is bounded, so it can be broadcast; repeated rows of the most labelled kind aside, it holds about sample_rows rows
    rows = docs.select(key, F.col(text).cast("binary").alias("t")).join(F.broadcast(known), key).select("__quarry_y", _features("t").alias("x"))
    got = rows.toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    y = got["__quarry_y"].to_numpy(np.float64)
    order = np.lexsort((y, *x.T))  # the same sums, whatever the order in which rows came
    return Model(x[order], y[order])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([features(b"" if t is None else bytes(t)) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(told.value.score(x))

    return docs.withColumn(out, scored(F.col(text).cast("binary")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, by a model of labelled rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = F.col("score")
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(s >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents under the threshold go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "__quarry_quality"
    return score(docs, model, out=name).where(F.col(name) >= THRESHOLD).drop(name)
