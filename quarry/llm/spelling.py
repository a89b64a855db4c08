"""Spelling variants: words one code point apart, by deletion keys from rolling hashes.

Two words are near if one code point is inserted, deleted or replaced between them. Both kinds
meet in the strings that deleting one code point gives: words that differ at place i are equal
once place i is deleted, and a word with one code point more becomes the shorter word itself.

The key of word w without place i comes from polynomial hashes of its prefixes and suffixes, for
all words and places in one vectorised pass; no shortened string is made. Keys are split into
parts by their leading bits, as many as keep a part bounded, and sorted within; those that meet
another are joined to their words, and groups of equal keys verified on the strings themselves. Nothing is paired within a group: of the words that
differ at one place each counts the others and takes the best of the rest, which the first two
of the group in order tell.

A word's form is its near word of largest count (ties: smallest) if that count is ``ratio`` times
the word's or more, and its root the end of the chain of forms, found by doubling pointers.

Defined results: null texts hold no words; a null id changes no run (see ``runs``); repeated rows
count again; words of any length are whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import lookup_join, ship, staged

#: Different words counted in a task before it passes them on, keys in a part, and letters of the words keyed at once.
HELD, PART, LETTERS = 200_000, 1 << 19, 1 << 18
#: Kinds of keys.
REPLACED, LONGER, WHOLE = 0, 1, 2
#: Multiplier of the polynomial hashes, modulo 2^64; odd.
BASE = 0x9E3779B97F4A7C15

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(did, text: str, least: int, one_in: int) -> Iterator[str]:
    """The lower-cased runs of letters of a text of at least ``least`` code points.

    A run whose checksum with the document's id is divisible by ``one_in`` loses a code point,
    at the checksum's place: misspellings whose origin is known.
    """
    seed = None if did is None else zlib.crc32(f"{did}:".encode())
    for w in _RUN.findall(text.translate(_LOWER)):
        if seed is not None and one_in:
            h = zlib.crc32(w.encode(), seed)
            if h % one_in == 0:
                h %= len(w)
                w = w[:h] + w[h + 1 :]
        if len(w) >= least:
            yield w


def _counter(least: int, one_in: int) -> Callable:
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for pdf in pdfs:
            for did, text in zip(pdf["did"], pdf["text"], strict=True):
                held.update(runs(did, text, least, one_in))
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return run


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, occurrences: int = 3, one_in: int = 0) -> DataFrame:
    """(word, n) of all words of at least ``least`` code points and ``occurrences`` occurrences."""
    d = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("did"), F.col(text).alias("text"))
    each = d.mapInPandas(_counter(least, one_in), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, kind, place, key): each word without each of its code points, for words that differ there (``REPLACED``)
    and for the word that is left (``LONGER``: one of equal neighbours is enough), and each word itself (``WHOLE``).

    With h(s) the sum of s[j] * B^j, a word without place i is h(prefix) + (h(word) - h(prefix and
    i)) / B: all from one running sum over all words laid end to end.
    """
    lens = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(lens) - lens
    of = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(codes)) - start[of]
    powers = np.full(int(lens.max(initial=0)) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = powers.cumprod(dtype=np.uint64)
    running = np.append(np.uint64(0), np.cumsum(codes * powers[place], dtype=np.uint64))
    at = np.arange(len(codes))
    before = running[at] - running[start[of]]
    after = running[start[of] + lens[of]] - running[at + 1]
    rest = before + after * np.uint64(pow(BASE, -1, 1 << 64))
    new = (place == 0) | np.append(True, codes[1:] != codes[:-1])[: len(codes)]
    whole = running[start + lens] - running[start]
    kind = np.repeat([REPLACED, LONGER, WHOLE], [len(codes), np.count_nonzero(new), len(words)])
    key = np.concatenate((rest + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB), rest[new], whole))
    return np.concatenate((of, of[new], np.arange(len(words)))), kind, np.concatenate((place, place[new], np.full(len(words), -1))), _mixed(key)


def _keyed(bits: int) -> Callable:
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in pdfs:
            letters = np.cumsum(whole["word"].str.len().to_numpy()) // LETTERS
            for _, pdf in whole.groupby(letters):
                of, kind, place, key = deletion_keys(pdf["word"].tolist())
                part = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
                yield pd.DataFrame({"part": part, "key": key.view(np.int64), "kind": kind.astype(np.int8), "place": place.astype(np.int32), "wid": pdf["wid"].to_numpy()[of]})

    return run


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a part of the keys that meet another: words without the same place, or a word and those that become it."""
    pdf = pdf.iloc[np.argsort(pdf["key"].to_numpy(), kind="stable")]
    key, kind = pdf["key"].to_numpy(), pdf["kind"].to_numpy()
    group = np.cumsum(np.append(False, key[1:] != key[:-1]))
    size = lambda k: np.bincount(group, kind == k)[group]
    return pdf[((kind == REPLACED) & (size(REPLACED) > 1)) | ((kind == LONGER) & (size(WHOLE) > 0)) | ((kind == WHOLE) & (size(LONGER) > 0))]


def _near(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the words of a part of the keys: how many near words a group gives, and the best of them.

    Groups are by the strings that deletion leaves, so rows whose keys only collide are told apart.
    """
    groups: dict[tuple, list[tuple[int, str]]] = {}
    for key, kind, place, word, n in zip(pdf["key"], pdf["kind"], pdf["place"], pdf["word"], pdf["n"], strict=True):
        left = word if kind == WHOLE else word[:place] + word[place + 1 :]
        groups.setdefault((key, place if kind == REPLACED else kind, kind == REPLACED, left), []).append((-n, word))
    out: list[tuple[str, int, int, str]] = []
    for (key, _, replaced, left), found in groups.items():
        if replaced and len(found) > 1:
            one, two = heapq.nsmallest(2, found)
            out += [(f[1], len(found) - 1, -b[0], b[1]) for f in found for b in [two if f == one else one]]
        elif not replaced and found[0][1] == left and (longer := groups.get((key, LONGER, False, left))):
            best, own = min(longer), found[0]
            out.append((left, len(longer), -best[0], best[1]))
            out += [(w, 1, -own[0], left) for _, w in longer]
    return pd.DataFrame(out, columns=["word", "n_near", "near_n", "near"])


def near_words(counts: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): the number of near words and the best of them, of the words (wid, word, n) that have some."""
    total = counts.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    keys = counts.mapInPandas(_keyed((total // PART).bit_length()), "part long, key long, kind byte, place int, wid long")
    met = keys.groupBy("part").applyInPandas(_met, "part long, key long, kind byte, place int, wid long")
    # only here do keys get their words: a long word isn't carried by each of its keys
    found = met.join(counts, "wid").groupBy("part").applyInPandas(_near, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def _rooted(words: DataFrame) -> DataFrame:
    """``words`` with ``root``: where following ``form`` ends. A form counts more than its word, so chains end."""
    step = staged(words.where("form IS NOT NULL").select("word", F.col("form").alias("to")), "forms")
    while True:
        on = step.select(F.col("word").alias("to"), F.col("to").alias("on"))
        moved = staged(lookup_join(step, on, "to", F.col("word"), salts=1).select("word", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")), "forms")
        step = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return words.join(step.withColumnRenamed("to", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, occurrences: int = 3, ratio: int = 2, one_in: int = 0) -> DataFrame:
    """The words of all texts: word, n, n_near, form, form_n and root.

    With ``one_in``, runs are changed as ``runs`` says.
    """
    ship(docs.sparkSession)
    counts = word_counts(docs, key, text, least, occurrences, one_in)
    counts = staged(counts.withColumn("wid", F.monotonically_increasing_id()), "words")
    words = counts.join(near_words(counts), "word", "left")
    far = F.col("near_n") >= ratio * F.col("n")
    words = staged(words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("near")).alias("form"), F.when(far, F.col("near_n")).alias("form_n")), "variants")
    return _rooted(words)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of ``documents``, one run in 97 with a code point deleted."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), one_in=97).select("word", "form", "root", "n", "n_near", "form_n")
