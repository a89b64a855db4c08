"""Suffix-array dedup: removes bytes covered by strings of ``LEAST`` bytes that also start in a document with a smaller id.

A window is a string of ``LEAST`` bytes. Its fingerprint is the smallest hash of the ``GRAM``-byte
strings in it, so equal windows have equal fingerprints, and neighbouring windows mostly share
one: a segment is a run of windows with one fingerprint, and every window is in one segment.

1. Of documents with equal texts only that with the smallest id is searched; the others go whole.
   The searched ones are packed into blocks.
2. Blocks report their fingerprints (five bytes each, by bucket); buckets tell which of them
   several documents share. Only those segments go on: what only one document has can't repeat.
3. Blocks send the shared segments, each text once with its smallest document id, to buckets by
   fingerprint. Fingerprints of more than ``HOT`` documents are cut into single windows, so
   that a phrase that very many documents hold in different surroundings is spread out.
4. A bucket builds the Burrows-Wheeler transform of its different segments, a few MB at a time,
   and extends all intervals backwards, breadth first: the boundaries found in round l are those
   of common prefixes of l bytes. It stops at ``LEAST``: suffixes that no boundary parts by then
   begin with the same window, and the smallest document id among them decides for all.
5. Blocks turn the windows into byte ranges and cut them out.

Defined results: a null text is empty; texts under ``LEAST`` bytes keep everything; rows with
equal ids don't remove bytes of each other, so a repeated row gets the same result each time;
null ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import release, ship, staged

#: Length in bytes from which a repeat is removed.
LEAST = 50
#: Length of the hashed strings that choose a window's fingerprint.
GRAM = 24
#: Bytes of text in a block (a longer text is a block by itself) and in one pass of hashing.
BLOCK, CHUNK = 2 << 20, 1 << 19
#: Bytes of text for each bucket, and of segments in one transform.
BUCKET, TRANSFORM = 8 << 20, 2 << 20
#: Windows of a segment at most, and documents of a fingerprint from which its windows go singly.
LONGEST, HOT = 4096, 20_000

def _small(data: bytes) -> bytes:
    """Texts travel compressed: blocks are shuffled once for each time they are asked something."""
    return zstandard.compress(data, 3)


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _K2
    return h ^ (h >> np.uint64(32))


def _window_minima(b: np.ndarray) -> np.ndarray:
    """The fingerprint of the window at each place of ``b`` that has one."""
    n = len(b) - 7
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word |= b[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    n = len(b) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for j in range(0, GRAM, 8):
        h = (h ^ word[j : j + n]) * _K1
        h ^= h >> np.uint64(29)
    h = _mixed(h)
    width, have = LEAST - GRAM + 1, 1
    low, out = h, len(h) - width + 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:out], low[width - have : width - have + out])


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, fingerprint) of each segment of texts laid end to end; ``ends`` are their ends."""
    starts, runs, prints = [], [], []
    # windows over the end of a text don't count
    for at in range(0, max(len(data) - LEAST + 1, 0), CHUNK):
        low = _window_minima(data[at : at + CHUNK + LEAST - 1])
        inside = np.ones(len(low), bool)
        near = ends[(ends > at) & (ends < at + len(low) + LEAST)]
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        for e in near:
            inside[max(e - LEAST + 1 - at, 0) : max(e - at, 0)] = False
            if e - at < len(low):
                new[e - at] = True
        new[1:] |= inside[1:] & ~inside[:-1]
        s = np.flatnonzero(new & inside)
        # a segment ends where the next begins or windows stop counting
        stop = np.flatnonzero(new | ~inside)
        nxt = np.append(stop, len(low))[np.searchsorted(stop, s, "right")]
        starts.append(s + at), runs.append(nxt - s), prints.append(_mixed(low[s] * _K1))
    if not starts:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    s, n, p = np.concatenate(starts), np.concatenate(runs), np.concatenate(prints)
    if len(n) and n.max() > LONGEST:
        k = -(-n // LONGEST)
        i = np.repeat(np.arange(len(n)), k)
        j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        s, n, p = s[i] + j * LONGEST, np.minimum(n[i] - j * LONGEST, LONGEST), p[i]
    return np.searchsorted(ends, s, "right"), s, n, p


def _buckets(prints: np.ndarray, buckets: int) -> np.ndarray:
    return ((prints >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def _slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each run of a sorted array."""
    at = np.flatnonzero(np.append(len(sorted_keys) > 0, sorted_keys[1:] != sorted_keys[:-1]))
    for a, b in zip(at, np.append(at[1:], len(sorted_keys)), strict=False):
        yield int(sorted_keys[a]), int(a), int(b)


def _distinct(texts: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different fingerprints in order, how many texts have each, and the place of each segment's own."""
    known, own = np.unique(prints, return_inverse=True)
    pairs = np.unique(own.astype(np.int64) * (int(texts.max()) + 1 if len(texts) else 1) + texts)
    each = np.bincount(pairs // (int(texts.max()) + 1), minlength=len(known)) if len(texts) else np.zeros(0, np.int64)
    return known, each, own


def _packed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (did, data) packed into blocks."""
    held, size = [], 0

    def block() -> pd.DataFrame:
        data = [bytes(d) for _, d in held]
        return pd.DataFrame({"dids": [np.array([i for i, _ in held], np.int64).tobytes()], "ends": [np.cumsum([len(d) for d in data], dtype=np.int64).tobytes()], "data": [_small(b"".join(data))], "size": [size]})

    for pdf in rows:
        for row in zip(pdf["did"], pdf["data"], strict=True):
            if held and size + len(row[1]) > BLOCK:
                yield block()
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield block()


def _opened(data: bytes, ends: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.decompress(data), np.uint8), np.frombuffer(ends, np.int64)


def _reports(buckets: int):
    """The fingerprints of blocks, by bucket: the low 40 bits of each, and how many documents have it (255: or more)."""

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks:
            for block, data, ends in zip(pdf["block"], pdf["data"], pdf["ends"], strict=True):
                texts, _, _, prints = segments(*_opened(data, ends))
                known, each, _ = _distinct(texts, prints)
                low = np.ascontiguousarray(known).view(np.uint8).reshape(-1, 8)[:, :5]
                each = np.minimum(each, 255).astype(np.uint8)
                out = [(k, block, low[a:b].tobytes(), each[a:b].tobytes()) for k, a, b in _slices(_buckets(known, buckets))]
                yield pd.DataFrame(out, columns=["bucket", "block", "prints", "each"])

    return run


def _shared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of a bucket's fingerprints several documents share (1) or very many (2), aligned with each report."""
    low = np.zeros((sum(map(len, pdf["each"])), 8), np.uint8)
    low[:, :5] = np.frombuffer(b"".join(pdf["prints"]), np.uint8).reshape(-1, 5)
    each = np.frombuffer(b"".join(pdf["each"]), np.uint8).astype(np.int64)
    _, own = np.unique(low.view(np.uint64).ravel(), return_inverse=True)
    docs = np.bincount(own, weights=each)[own]
    flags = (docs >= 2).astype(np.uint8) + (docs > HOT)
    cut = np.append(0, np.cumsum([len(x) for x in pdf["each"]]))
    return pd.DataFrame({"bucket": key[0], "block": pdf["block"], "flags": [flags[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})


def _sent(buckets: int):
    """The shared segments of blocks: to each bucket the different texts with their smallest document ids, and to the block its places."""

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks:
            for block, data, ends, dids, flags in zip(pdf["block"], pdf["data"], pdf["ends"], pdf["dids"], pdf["flags"], strict=True):
                bytes_of, ends = _opened(data, ends)
                raw, dids = bytes_of.tobytes(), np.frombuffer(dids, np.int64)
                texts, starts, runs, prints = segments(bytes_of, ends)
                own = np.unique(prints, return_inverse=True)[1]
                flag = np.frombuffer(b"".join(x["flags"] for x in flags), np.uint8)[own]
                one = flag == 1
                t, s, n, p = texts[one], starts[one], runs[one], prints[one]
                if (hot := flag == 2).any():
                    k = runs[hot]
                    at = np.repeat(starts[hot] - np.cumsum(k) + k, k) + np.arange(k.sum())
                    prints_of = np.array([xxhash.xxh64_intdigest(raw[a : a + LEAST]) for a in at], np.uint64)
                    t, s, n, p = np.append(t, np.repeat(texts[hot], k)), np.append(s, at), np.append(n, np.ones(len(at), np.int64)), np.append(p, prints_of)
                order = np.argsort(p, kind="stable")
                t, s, n, p = t[order], s[order], n[order], p[order]
                entry, seen, first = np.zeros(len(s), np.uint32), {}, []
                for i, (a, b) in enumerate(zip(s.tolist(), (s + n + LEAST - 1).tolist(), strict=True)):
                    e = seen.setdefault(raw[a:b], len(seen))
                    if e == len(first):
                        first.append(i)
                    entry[i] = e
                low = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(low, entry, dids[t])
                contents, fp = list(seen), p[first]
                out = []
                for k, a, b in _slices(_buckets(fp, buckets)):
                    lens = np.array([len(c) for c in contents[a:b]], np.uint32)
                    out.append((k, block, a, _small(b"".join(contents[a:b])), lens.tobytes(), low[a:b].tobytes(), fp[a:b].tobytes()))
                out.append((-1, block, len(first), b"", np.stack([s.astype(np.int64), n.astype(np.int64)]).tobytes(), (dids[t] > low[entry]).tobytes(), entry.tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "block", "base", "contents", "lens", "dids", "ids"])

    return run


def sorted_suffixes(sym: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order; ``sym`` are bytes + 1 with a 0 after each text, ``left`` the bytes up to it.

    Sorted by seven symbols, then by doubling, each round only over what is still tied; equal
    suffixes stay in the order of their places.
    """
    places = np.flatnonzero(left > 0)
    key = np.zeros(len(places), np.int64)
    for j in range(7):
        key = (key << 9) | np.where(left[places] > j, sym[np.minimum(places + j, len(sym) - 1)], 0)
    order = np.argsort(key, kind="stable")
    sa, key = places[order], key[order]
    rank = np.zeros(len(sym), np.int64)
    slots, same = np.arange(len(sa)), np.append(False, key[1:] == key[:-1])
    first = np.maximum.accumulate(np.where(same, 0, slots))
    rank[sa] = first
    h = 7
    while True:
        tied = (same | np.append(same[1:], False)) & (left[sa[slots]] >= h)
        slots, first = slots[tied], first[tied]
        if not len(slots):
            return sa
        items = sa[slots]
        key = first * (len(sym) + 1) + np.where(left[items] > h, rank[np.minimum(items + h, len(sym) - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        items, key = items[order], key[order]
        sa[slots] = items
        same = np.append(False, key[1:] == key[:-1])
        first = np.maximum.accumulate(np.where(same, 0, slots))
        rank[items] = first
        h *= 2


def common_prefixes(sym: np.ndarray, left: np.ndarray, sa: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The length of each suffix's common prefix with the one before it in order; ``least`` stands for that or more.

    All intervals of suffixes with a common prefix of l bytes are extended backwards by every
    byte at once: two neighbours stay in one interval if they begin with the same byte and what
    follows lies in one interval of the round before. Only neighbours not parted yet are looked at.
    """
    bwt = np.where(sa > 0, sym[sa - 1], 0)
    back = np.argsort(bwt, kind="stable")
    # the suffix that follows a suffix's first byte: the transform's symbols in stable order
    follows = np.full(len(sa), -1, np.int64)
    follows[left[sa] > 1] = back[np.count_nonzero(bwt == 0) :]
    head = sym[sa]
    part = np.append(True, head[1:] != head[:-1])
    lcp = np.zeros(len(sa), np.int64)
    live = np.flatnonzero(~part)
    for length in range(1, least):
        interval = np.cumsum(part, dtype=np.int32)
        a, b = follows[live - 1], follows[live]
        parted = (a < 0) | (b < 0) | (interval[a] != interval[b])
        now = live[parted]
        lcp[now] = length
        part[now] = True
        live = live[~parted]
        if not len(live):
            break
    lcp[live] = least
    return lcp


def smallest_holders(contents: list[bytes], holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``contents``, laid end to end with a gap of one, the smallest holder of any content with that window; and where each content starts."""
    lens = np.array([len(c) for c in contents], np.int64)
    starts = np.append(0, np.cumsum(lens + 1))[:-1]
    sym = np.append(np.frombuffer(b"\0".join(contents), np.uint8).astype(np.int64) + 1, 0)
    sym[starts + lens] = 0
    left = np.repeat(starts + lens, lens + 1) - np.arange(len(sym))
    sa = sorted_suffixes(sym, left)
    lcp = common_prefixes(sym, left, sa)
    group = np.flatnonzero(lcp < LEAST)
    of = np.repeat(np.arange(len(contents)), lens + 1)
    low = np.minimum.reduceat(holders[of[sa]], group)
    out = np.full(len(sym), np.iinfo(np.int64).max)
    out[sa] = np.repeat(low, np.diff(np.append(group, len(sa))))
    out[left < LEAST] = np.iinfo(np.int64).max
    return out, starts


def _decided(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the segments sent to a bucket, the ranges of windows to remove, as (entry, from, to) of each block."""
    row, entry, contents, holders, prints = [], [], [], [], []
    for r, (base, data, lens, dids, ids) in enumerate(zip(pdf["base"], pdf["contents"], pdf["lens"], pdf["dids"], pdf["ids"], strict=True)):
        cut = np.append(0, np.cumsum(np.frombuffer(lens, np.uint32), dtype=np.int64))
        data = zstandard.decompress(data)
        contents += [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        row.append(np.full(len(cut) - 1, r)), entry.append(np.arange(base, base + len(cut) - 1))
        holders.append(np.frombuffer(dids, np.int64)), prints.append(np.frombuffer(ids, np.uint64))
    row, entry, holders, prints = map(np.concatenate, (row, entry, holders, prints))
    seen: dict[bytes, int] = {}
    own = np.array([seen.setdefault(c, len(seen)) for c in contents])
    texts = list(seen)
    first = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(first, own, holders)
    fp = np.zeros(len(texts), np.uint64)
    fp[own] = prints
    del contents, seen
    # a few MB at a time; a fingerprint's segments stay together
    order = np.argsort(fp, kind="stable")
    lens = np.array([len(texts[i]) for i in order.tolist()], np.int64)
    total = np.cumsum(lens)
    ends = np.flatnonzero(np.append(fp[order][1:] != fp[order][:-1], True)) + 1
    of, low, high, at = [], [], [], 0
    while at < len(order):
        to = int(ends[min(np.searchsorted(ends, np.searchsorted(total, (total[at - 1] if at else 0) + TRANSFORM, "right")), len(ends) - 1)])
        part, at = order[at:to], to
        smallest, starts = smallest_holders([texts[i] for i in part.tolist()], first[part])
        n = np.diff(np.append(starts, len(smallest)))
        gone = smallest < np.repeat(first[part], n)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
        a, b = edge[::2], edge[1::2]
        c = np.searchsorted(starts, a, "right") - 1
        of.append(part[c]), low.append(a - starts[c]), high.append(b - starts[c])
    of, low, high = np.concatenate(of), np.concatenate(low), np.concatenate(high)
    # the first holder of a text loses what others had before; every other holder loses all of it
    later = np.flatnonzero(holders > first[own])
    mine = np.flatnonzero(holders == first[own])
    by = np.argsort(of, kind="stable")
    a, b = np.searchsorted(of[by], own[mine]), np.searchsorted(of[by], own[mine], "right")
    k = b - a
    pick = by[np.repeat(a - np.cumsum(k) + k, k) + np.arange(k.sum())]
    size = np.array([len(t) for t in texts], np.int64) - LEAST + 1
    where = np.append(later, np.repeat(mine, k))
    ranges = np.stack([entry[where], np.append(np.zeros(len(later), np.int64), low[pick]), np.append(size[own[later]], high[pick])], 1).astype(np.uint32)
    by = np.argsort(row[where], kind="stable")
    blocks = pdf["block"].to_numpy()
    return pd.DataFrame([(blocks[r], ranges[by[a:b]].tobytes()) for r, a, b in _slices(row[where][by])], columns=["block", "ranges"])


def _cut_out(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The removed byte ranges of each document of the blocks, and what stays."""
    for pdf in blocks:
        for data, ends, dids, lens, later, ids, count, ranges in zip(pdf["data"], pdf["ends"], pdf["dids"], pdf["lens"], pdf["later"], pdf["ids"], pdf["base"], pdf["ranges"], strict=True):
            (raw, ends), dids = _opened(data, ends), np.frombuffer(dids, np.int64)
            delta = np.zeros(len(raw) + 1, np.int32)
            if lens is not None:
                s, n = np.frombuffer(lens, np.int64).reshape(2, -1)
                later, entry = np.frombuffer(later, bool), np.frombuffer(ids, np.uint32)
                r = np.frombuffer(b"".join(ranges if ranges is not None else ()), np.uint32).astype(np.int64).reshape(-1, 3)
                r = r[np.argsort(r[:, 0], kind="stable")]
                first = np.searchsorted(r[:, 0], np.arange(int(count) + 1))
                # a document with a larger id than another of its block that holds the segment loses all of it
                k = np.where(later, 0, first[entry + np.uint32(1)] - first[entry]) if len(entry) else np.zeros(0, np.int64)
                pick = np.repeat(first[entry] - np.cumsum(k) + k, k) + np.arange(k.sum())
                a = np.append(s[later], np.repeat(s, k) + r[pick, 1])
                b = np.append(s[later] + n[later], np.repeat(s, k) + r[pick, 2]) + LEAST - 1
                np.add.at(delta, a, 1), np.add.at(delta, b, -1)
            gone = np.cumsum(delta[:-1]) > 0
            out = []
            for did, a, b in zip(dids.tolist(), np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], g, [False]))))
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                out.append((did, b - a, spans, raw[a:b][~g].tobytes() if spans else raw[a:b].tobytes()))
            yield pd.DataFrame(out, columns=["did", "n_bytes", "spans", "kept"])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_bytes, spans (removed byte ranges, ends exclusive) and kept (the bytes that stay).

    ``key`` is an integer column.
    """
    spark = docs.sparkSession
    ship(spark)
    none = F.lit(np.iinfo(np.int64).min)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), none).alias("did"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data")).withColumn("sha", F.sha2("data", 256))
    first = staged(rows.groupBy("sha").agg(F.min("did").alias("did")).select("did", "sha", F.lit(True).alias("first")), "first")
    # by id, so that no group of equal texts meets in one task
    marked = rows.join(first, ["did", "sha"], "left")
    blocks = marked.where("first").select("did", "data").mapInPandas(_packed, "dids binary, ends binary, data binary, size long")
    blocks = staged(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    release(spark)
    buckets = -(-(blocks.agg(F.sum("size")).first()[0] or 0) // BUCKET) or 1
    reports = blocks.select("block", "data", "ends").mapInPandas(_reports(buckets), "bucket long, block long, prints binary, each binary")
    flags = reports.groupBy("bucket").applyInPandas(_shared, "bucket long, block long, flags binary")
    flags = staged(flags, "flags").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "flags"))).alias("flags"))
    sent = blocks.join(flags, "block").mapInPandas(_sent(buckets), "bucket long, block long, base long, contents binary, lens binary, dids binary, ids binary")
    sent = staged(sent, "segments")
    release(spark)
    ranges = sent.where("bucket >= 0").groupBy("bucket").applyInPandas(_decided, "block long, ranges binary")
    ranges = staged(ranges, "ranges")
    release(spark)
    ranges = ranges.groupBy("block").agg(F.collect_list("ranges").alias("ranges"))
    places = sent.where("bucket < 0").select("block", "base", "lens", F.col("dids").alias("later"), "ids")
    found = blocks.join(places, "block", "left").join(ranges, "block", "left").mapInPandas(_cut_out, "did long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    # copies lose everything or are too short to lose anything, so their texts needn't be moved
    n = F.length("data").cast("long")
    short = rows.select("did", "sha", n.alias("n_bytes"), F.when(n < LEAST, F.col("data")).otherwise(F.lit(b"")).alias("kept"))
    kind = "array<struct<start: long, end: long>>"
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(F.col("n_bytes") < LEAST, F.array().cast(kind)).otherwise(whole)
    copies = short.join(first, ["did", "sha"], "left_anti").select("did", "n_bytes", spans.alias("spans"), "kept")
    return found.unionByName(copies).select(F.nullif(F.col("did"), none).alias(key), "n_bytes", "spans", "kept")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``: bytes, removed bytes and runs, and a SHA-256 of what stays."""
    r = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return r.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n, j * 1000 AS base, substr(h, (2000 * j + 1)::BIGINT, 2098) AS p FROM (SELECT doc_id, h, n, unnest(range(0, ((n - 50) // 1000 + 1)::BIGINT)) AS j FROM d WHERE n >= 50)),
w AS (SELECT doc_id, base + i AS i, hash(substr(p, (2 * i + 1)::BIGINT, 100)) AS w FROM (SELECT doc_id, base, p, unnest(range(0, least(1000, n - 49 - base)::BIGINT)) AS i FROM c)),
f AS (SELECT w, min(doc_id) AS f FROM w GROUP BY w),
g AS (SELECT w.doc_id, i FROM w JOIN f ON f.w = w.w WHERE f < w.doc_id),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM g)) GROUP BY doc_id, k),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT doc_id, max(b), NULL FROM s GROUP BY doc_id),
k AS (SELECT p.doc_id, string_agg(substr(h, (2 * x + 1)::BIGINT, (2 * (coalesce(y, n) - x))::BIGINT), '' ORDER BY x) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
