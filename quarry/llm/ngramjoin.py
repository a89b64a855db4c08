"""N-gram Jaccard join with vertical partitioning, and the components of its links.

Texts are lower-cased (A-Z) and cut at white space; a document's set holds its distinct
``n``-word shingles as 64-bit hashes. Shingle hashes are counted in ``BUCKETS`` buckets over
all documents, and the buckets ordered by count: rank of bucket, then hash, is the global
order, rare first. The order is cut into ``FRAGMENTS`` fragments of about equal mass.

1. Equal sets (by two 64-bit sums together) become one class with a short id.
2. Classes that share a min-hash are paired with one class of that min-hash, and the pairs
   that pass the join's own test are linked; this only shortens step 3.
3. Every pair that a prefix of the global order brings together, that passes length,
   positional, bitmap and count filters, and whose classes aren't yet in one component, is
   tested. The count filter: of two sets, the one whose prefix ends first in the global order
   has all common tokens of that prefix in the other's, so too few of them rule the pair out.
   The bitmap filter: parities of the tokens by 8 bits of their hashes can't differ in more
   places than the sets differ in tokens.
4. The test: each class's set is cut at the fragments into rows (fragment, class, tokens). A
   fragment's rows are joined with each other by the pairs to test, each giving a partial
   overlap by itself, and the partial counts are summed per pair. Before, the sizes of two
   sets in each fragment bound what their overlaps can sum to.
5. Components come from alternating large-star and small-star rounds.

No link between different components can be missed, because two sets over the threshold
share a token of their prefixes. Pairs inside a component that is already known are not
expanded, so a group of copies costs as many rows as it has members.

Defined results: documents without words have an empty set and are alone; with fewer than
``n`` words the whole sequence is the one shingle; an empty table gives no rows; repeated
rows are copies of each other; null ids take part but never name a component (a component
without any id has a null one); ties don't matter, as all links count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import forget, lookup_join, release, ship, staged

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
FRAGMENTS = 4
#: Min-hashes of a set, and how many of them two classes must share to be paired in step 2.
SIGNATURES, AGREE = 6, 3
#: Keys that may be broadcast to pick rows.
PICK_ROWS = 200_000
#: Bytes of text hashed at once.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240501)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SEEDS = _rng.integers(1, 1 << 63, SIGNATURES, dtype=np.uint64) | np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _hash_block(texts: list[bytes], n: int) -> list[np.ndarray]:
    data = b"\n".join([*texts, b""]).lower()
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    empty = np.empty(0, np.uint64)
    if not len(starts):
        return [empty] * len(texts)
    body, skip = b[starts[0] :], starts - starts[0]
    span = np.diff(np.append(skip, len(body)))
    at = np.arange(len(body)) - np.repeat(skip, span)
    power = np.ones(int(span.max()) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, _A), out=power[1:])
    value = _VALUE[body] * power[at]
    value[space[starts[0] :]] = 0
    words = _mix(np.add.reduceat(value, skip))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, ends)  # words up to each document's end
    k = len(words) - n + 1
    grams = empty
    if k > 0:
        grams = words[:k].copy()
        for j in range(1, n):
            grams = _mix(grams * _B + words[j : j + k])
    out, lo = [], 0
    for hi in cuts.tolist():
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            whole = words[lo : lo + 1]
            for j in range(lo + 1, hi):
                whole = _mix(whole * _B + words[j : j + 1])
            out.append(_mix(whole + np.uint64(hi - lo)))
        else:
            out.append(empty)
        lo = hi
    return out


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    block: list[bytes] = []
    size = 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size > BLOCK:
            yield from _hash_block(block, n)
            block, size = [], 0
    if block:
        yield from _hash_block(block, n)


class Order:
    """The global order of shingle hashes: ranks of buckets by count, and the fragments."""

    def __init__(self, counts: np.ndarray):
        by = np.argsort(counts, kind="stable")
        self.rank = np.empty(BUCKETS, np.uint64)
        self.rank[by] = np.arange(BUCKETS, dtype=np.uint64)
        mass = np.cumsum(counts[by])
        cut = mass * FRAGMENTS // max(1, int(mass[-1]) + 1)
        self.fragment = np.empty(BUCKETS, np.int8)
        self.fragment[by] = cut

    def keys(self, h: np.ndarray) -> np.ndarray:
        """The hashes re-coded as signed integers whose own order is the global one, ascending."""
        low = np.uint64(64 - BUCKET_BITS)
        keys = (self.rank[(h >> low).astype(np.int64)] << low) | (h & np.uint64((1 << (64 - BUCKET_BITS)) - 1))
        return np.sort((keys ^ np.uint64(1 << 63)).view(np.int64))

    def sizes(self, h: np.ndarray) -> np.ndarray:
        """How many of the hashes lie in each fragment."""
        return np.bincount(self.fragment[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], minlength=FRAGMENTS).astype(np.int32)

    def cut(self, h: np.ndarray) -> list[np.ndarray]:
        """The hashes of each fragment."""
        f = self.fragment[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        by = np.argsort(f, kind="stable")
        return np.split(h[by], np.searchsorted(f[by], np.arange(1, FRAGMENTS)))


def set_sums(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for the set."""
    return int(_mix(h).sum(dtype=np.uint64).view(np.int64)), int(_mix(h * _A + np.uint64(len(h))).sum(dtype=np.uint64).view(np.int64))


def global_order(docs: DataFrame, n: int) -> Order:
    """Counts the shingles of every document by bucket; the driver gets one number for each bucket."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for h in shingle_sets([bytes(t) for t in b["t"]], n):
                np.add.at(total, (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "c": total[at]})

    counts = np.zeros(BUCKETS, np.int64)
    for r in docs.select("t").mapInPandas(tally, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toPandas().itertuples(index=False):
        counts[r.bucket] = r.c
    return Order(counts)


def parities(h: np.ndarray) -> np.ndarray:
    """256 bits: the parity of the tokens at each value of a byte of their hashes."""
    return np.packbits(np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1).view(np.int64)


def describe(docs: DataFrame, order, n: int, num: int, den: int) -> DataFrame:
    """doc_id, row_key, n, h1, h2, sigs, bits, cuts (tokens in each fragment), prefix of each document."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o = order.value
        for b in batches:
            out = []
            for h in shingle_sets([bytes(t) for t in b["t"]], n):
                if not len(h):
                    out.append((0, 0, 0, None, None, None, None, 0))
                    continue
                sigs = (h[None, :] * _SEEDS[:, None] ^ (h[None, :] >> np.uint64(31))).min(1) if len(h) < 4096 else np.array([(h * s ^ (h >> np.uint64(31))).min() for s in _SEEDS])
                p = len(h) - -(-num * len(h) // den) + 1
                keys = o.keys(h)[:p]
                # 31 bits of a token are enough to find candidates
                out.append((len(h), *set_sums(h), sigs.view(np.int64), parities(h), o.sizes(h), (keys & 0x7FFFFFFF).astype(np.int32), int(keys[-1])))
            made = pd.DataFrame(out, columns=["n", "h1", "h2", "sigs", "bits", "cuts", "prefix", "last"])
            yield pd.concat([b[["doc_id", "row_key"]].reset_index(drop=True), made], axis=1)

    return docs.mapInPandas(rows, "doc_id string, row_key long, n long, h1 long, h2 long, sigs array<long>, bits array<long>, cuts array<int>, prefix array<int>, last long")


def overlaps(docs: DataFrame, pairs: DataFrame, classes: DataFrame, order, n: int) -> DataFrame:
    """a, b, na, nb, shared for each of ``pairs`` (a, b, na, nb) with a common token: one partial overlap for each fragment, summed.

    Sets are made again from the texts of one document of each class in a pair.
    """
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    keys = staged(classes.join(ids, "cid", "left_semi").select("row_key", "cid"), "keys")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o = order.value
        for b in batches:
            cids, sets = b["cid"].to_numpy(), shingle_sets([bytes(t) for t in b["t"]], n)
            rows = [(c, f, part.view(np.int64)) for c, h in zip(cids, sets, strict=True) for f, part in enumerate(o.cut(h)) if len(part)]
            yield pd.DataFrame(rows, columns=["cid", "fragment", "tokens"])

    picked = docs.join(F.broadcast(keys) if keys.count() <= PICK_ROWS else keys.hint("merge"), "row_key").select("cid", "t")
    # repeated rows of a document give its set again
    parts = staged(picked.mapInPandas(cut, "cid long, fragment int, tokens array<long>"), "fragments").dropDuplicates(["cid", "fragment"])
    side = lambda k: parts.select("fragment", F.col("cid").alias(k), F.col("tokens").alias(f"t{k}"))
    each = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    # merged: the planner doesn't see that pairs are repeated for each fragment, and the driver would hold them
    partial = each.join(side("a").hint("merge"), ["fragment", "a"]).join(side("b").hint("merge"), ["fragment", "b"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ta", "tb")).cast("long").alias("partial"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("shared"))


def _fragments_allow(ca: str, cb: str, both: Column, num: int, den: int) -> Column:
    """Whether the overlaps that the sizes in each fragment allow sum to enough for sets of ``both`` tokens together."""
    most = F.aggregate(F.zip_with(ca, cb, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return most * (num + den) >= num * both


def linked(o: DataFrame, num: int, den: int) -> DataFrame:
    return o.where(den * F.col("shared") >= num * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def _with_roots(e: DataFrame) -> DataFrame:
    """node, component from edges (u, v) that are stars: the centres belong to themselves."""
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b), by large-star and small-star rounds."""
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if e.isEmpty():
        return _with_roots(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        s = lookup_join(both.where("v > u"), low, "u", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(s.where("u <> v").distinct(), "edges")
        # small star: smaller neighbours and the node itself go to the least
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        s = lookup_join(e, low, "u", F.col("v"))
        s = s.select(F.col("v").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v")))
        e = staged(s.where("u <> v").distinct(), "edges")
        # done when every node has one edge, to a node that has none to a smaller one
        fan = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if fan.where("n > 1").isEmpty() and e.join(fan.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return _with_roots(e)


def _long_enough(a: Column, b: Column, num: int, den: int) -> Column:
    return (den * a >= num * b) & (den * b >= num * a)


def classes_of(docs: DataFrame, n: int, num: int, den: int, rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, n, h1, h2; per class with company: h1, h2, component_id). ``docs``: doc_id, t (binary), row_key.

    With ``rows``, documents have their row_key too, and classes top, which tells components apart whose ids repeat.
    """
    spark = docs.sparkSession
    ship(spark)
    order = spark.sparkContext.broadcast(global_order(docs, n))
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "row_key", "t")
    d = staged(describe(texts, order, n, num, den), "documents")
    c = d.where("n > 0").groupBy("h1", "h2").agg(F.min(F.col("doc_id").cast(kind)).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("row_key").alias("row_key"), *(F.first(x).alias(x) for x in ("n", "sigs", "bits", "cuts", "prefix", "last")))
    c, whole = staged(c.withColumn("cid", F.monotonically_increasing_id()), "classes"), d
    d = staged(d.select("doc_id", "n", "h1", "h2", *["row_key"] * rows), "documents")
    forget(whole)

    # step 2
    g = c.select("cid", "n", "sigs", "cuts", F.posexplode("sigs").alias("j", "sig")).withColumn("key", F.xxhash64("j", "sig"))
    heads = g.groupBy("key").agg(F.min(F.struct(F.xxhash64("cid", "key"), F.col("cid").alias("hid"), F.col("n").alias("hn"), F.col("sigs").alias("hs"), F.col("cuts").alias("hc"))).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "h.hid", "h.hn", "h.hs", "h.hc")
    g = lookup_join(g, heads, "key", F.col("cid"), salts=8).where("hid IS NOT NULL AND hid <> cid")
    same = sum(((F.col("sigs")[i] == F.col("hs")[i]).cast("int") for i in range(SIGNATURES)), F.lit(0))
    g = g.where((same >= AGREE) & _long_enough(F.col("n"), F.col("hn"), num, den) & _fragments_allow("cuts", "hc", F.col("n") + F.col("hn"), num, den))
    pairs = staged(g.select(F.least("cid", "hid").alias("a"), F.greatest("cid", "hid").alias("b"), F.when(F.col("cid") < F.col("hid"), F.col("n")).otherwise(F.col("hn")).alias("na"), F.when(F.col("cid") < F.col("hid"), F.col("hn")).otherwise(F.col("n")).alias("nb")).distinct(), "pairs")
    early = staged(components(linked(overlaps(docs, pairs, c, order, n), num, den)), "components")
    forget(pairs)

    # step 3
    x = lookup_join(c.select("cid", "n", "prefix"), early.withColumnRenamed("node", "cid"), "cid", F.col("n"), salts=1)
    x = x.select("cid", "n", F.coalesce("component", "cid").alias("comp"), F.posexplode("prefix").alias("pos", "token"))
    x = x.select("token", "cid", "comp", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("m"))
    # tokens of one component only can't link two; staged, so that the join's sides can be split where a token is frequent
    x = staged(x, "tokens")
    several = x.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    # only the few that stay get their class's parities
    bits = c.select("cid", *(F.col("bits")[i].alias(f"b{i}") for i in range(4)))
    every, x = x, staged(x.join(several, "token", "left_semi").join(bits, "cid").select("token", "cid", "comp", "m", *(f"b{i}" for i in range(4))), "tokens")
    forget(every)
    l, r = (x.select("token", *(F.col(k).alias(k + s) for k in x.columns[1:])) for s in "12")
    n1, n2 = (F.shiftright(f"m{s}", 32).cast("int") for s in "12")
    pos1, pos2 = (F.col(f"m{s}").bitwiseAND(0x7FFFFFFF).cast("int") for s in "12")
    most = F.least(n1 - pos1, n2 - pos2)
    apart = sum((F.bit_count(F.col(f"b{i}1").bitwiseXOR(F.col(f"b{i}2"))) for i in range(4)), F.lit(0))
    ok = (F.col("cid1") < F.col("cid2")) & (F.col("comp1") != F.col("comp2")) & _long_enough(n1, n2, num, den) & (most * (num + den) >= num * (n1 + n2)) & (apart * (den + num) <= (den - num) * (n1 + n2))
    found = l.join(r, "token").where(ok).select(F.col("cid1").alias("a"), F.col("cid2").alias("b"), n1.cast("long").alias("na"), n2.cast("long").alias("nb"), F.col("comp1").alias("ca"), F.col("comp2").alias("cb")).distinct()
    found = staged(found, "pairs")
    release(spark)
    for k in "ab":
        found = found.join(c.select(F.col("cid").alias(k), F.col("prefix").alias(f"p{k}"), F.col("last").alias(f"l{k}"), F.col("cuts").alias(f"cut_{k}")).hint("merge"), k)
    first = F.col("la") <= F.col("lb")
    # tokens that share their 31 bits make one, so no more are counted as missing than are
    missing = F.size(F.array_except(F.when(first, F.col("pa")).otherwise(F.col("pb")), F.when(first, F.col("pb")).otherwise(F.col("pa"))))
    enough = missing <= F.when(first, F.col("na")).otherwise(F.col("nb")) - F.ceil(num * (F.col("na") + F.col("nb")) / F.lit(num + den))
    found = staged(found.where(enough & _fragments_allow("cut_a", "cut_b", F.col("na") + F.col("nb"), num, den)).select("a", "b", "na", "nb", "ca", "cb"), "pairs")
    late = linked(overlaps(docs, found.select("a", "b", "na", "nb"), c, order, n), num, den).join(found.select("a", "b", "ca", "cb").hint("merge"), ["a", "b"])
    late = staged(components(late.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()), "components")
    forget(found)

    # names: the least document id of each component
    m = lookup_join(c.select("cid", "h1", "h2", "first_id", "copies"), early.select(F.col("node").alias("cid"), F.col("component").alias("comp")), "cid", F.col("copies"), salts=1)
    m = m.withColumn("comp", F.coalesce("comp", "cid"))
    m = lookup_join(m, late.select(F.col("node").alias("comp"), F.col("component").alias("top")), "comp", F.col("cid")).withColumn("top", F.coalesce("top", "comp"))
    m = staged(m.select("h1", "h2", "top", "first_id", "copies"), "members")
    names = m.groupBy("top").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("size")).where("size > 1").select("top", "component_id")
    named = lookup_join(m, names.withColumn("found", F.lit(True)), "top", F.col("h1")).where("found").select("h1", "h2", "component_id", "found", *["top"] * rows)
    return d.select(F.col("doc_id").cast(kind).alias("doc_id"), "n", "h1", "h2", *["row_key"] * rows), named


def _prepared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("t"), F.xxhash64(F.col(key), F.col(text)).alias("row_key"))


def similar_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: documents with a Jaccard similarity of num / den or more are linked."""
    d, named = classes_of(_prepared(docs, key, text), n, num, den)
    out = lookup_join(d, named, ["h1", "h2"], F.xxhash64("doc_id"))
    alone = ~F.coalesce("found", F.lit(False)) | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` less all but the row with the least id of each component.

    Decided by row (id and text): rows that share an id but not a component don't affect each
    other, rows equal in both become one, and rows without words or without an id stay.
    """
    d, named = classes_of(_prepared(docs), n, num, den, rows=True)
    c = lookup_join(d, named, ["h1", "h2"], F.col("row_key")).where("found AND n > 0 AND doc_id IS NOT NULL")
    c = staged(c.groupBy("top", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "components")
    first = c.groupBy("top").agg(F.min(F.struct("doc_id", "row_key")).alias("f")).select("top", F.col("f.row_key").alias("first"))
    c = staged(lookup_join(c, first, "top", F.col("row_key")).select("row_key", "copies", (F.col("row_key") == F.col("first")).alias("stays")), "components")
    key = "__quarry_row"
    gone, twice = c.where("NOT stays").select(F.col("row_key").alias(key)), c.where("stays AND copies > 1").select(F.col("row_key").alias(key))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    kept = keyed.join(F.broadcast(gone) if gone.count() <= PICK_ROWS else gone, key, "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    marked = kept.join(twice.withColumn("__quarry_twice", F.lit(True)), key, "left")
    once = marked.where("__quarry_twice IS NULL").drop("__quarry_twice")
    more = marked.where("__quarry_twice").drop("__quarry_twice").dropDuplicates([key])
    return once.unionByName(more).select(*docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``: three-word shingles, similarity of 0.9 or more."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays (five-word shingles, 0.8)."""
    return one_of_each(docs)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, (greatest(len(w) - 2, 1) + 1)::BIGINT)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.doc_id
"""
