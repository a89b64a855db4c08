"""What is counted in texts from their bytes: an Arrow batch a time, of which slices of about a megabyte are held in Python.

The functions that tasks run are made within others and use nothing of this package, so workers need not have it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are worked on at a time; a text is never cut.
SLICE = 1 << 20
#: Upper-case letters outside ASCII whose lower case begins with a letter of ASCII, in UTF-8, with that lower case.
_WIDE = ((b"\xe2\x84\xaa", b"k"), (b"\xc4\xb0", b"i\xcc\x87"))


def _slices():
    """A function from a string array to lists of its texts' bytes (None: null), of ``SLICE`` bytes or one text."""
    most = SLICE

    def slices(a):
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(a), 0).to_pylist()
        at = held = 0
        for i, n in enumerate(sizes):
            if i > at and held + n > most:
                yield a.slice(at, i - at).cast(pa.large_binary()).to_pylist()
                at, held = i, 0
            held += n
        if at < len(sizes):
            yield a.slice(at).cast(pa.large_binary()).to_pylist()

    return slices


def _lower():
    """A function from bytes to bytes in which every letter whose lower case is in ASCII is so."""
    table = bytes(range(256)).lower()
    wide = _WIDE

    def lower(t: bytes) -> bytes:
        for a, b in wide:
            if a in t:
                t = t.replace(a, b)
        return t.translate(table)

    return lower


def text_counts(text: Column, terms: dict[str, list[str]]) -> Column:
    """struct<s, w, y, l, categories> of a text: its sentences, words, runs of vowels, characters other than white space, and the keys of ``terms`` of which the lower-cased text holds a value.

    Sentences are the pieces, not empty, between U+0001 and the white space after a full stop, exclamation or question mark. The four counts of a null text are null.
    """
    WORD, VOWEL, SPACE, END, MARK, FIRST = (1 << i for i in range(6))
    white = b" \t\n\x0b\f\r"
    table = bytearray(256)
    for b in range(255):
        table[b] = (0 if b in white else WORD | (0 if b & 0xC0 == 0x80 else FIRST)) | (VOWEL if b in b"aeiouyAEIOUY" else 0) | (SPACE if b in b" \t\r\n" else 0) | (END if b in b".!?" else 0) | (MARK if b == 1 else 0)
    # between texts stands a byte that UTF-8 doesn't have
    sep = b"\xff"
    table[255] = MARK
    classes = bytes(table)
    sought = {k: [v.encode() for v in vs] for k, vs in terms.items()}
    slices, lower = _slices(), _lower()

    def held(texts: list, joined: bytes, starts) -> list[list[str]]:
        """The categories of each text."""
        from bisect import bisect_right

        low = lower(joined)
        if len(low) != len(joined):
            starts, n = [], 1
            for t in texts:
                starts.append(n)
                n += len(lower(t)) + 1
        ends = [*starts[1:], len(low)]
        out: list[list[str]] = [[] for _ in texts]
        for k, vs in sought.items():
            rows = set()
            for v in vs:
                p = low.find(v)
                while p >= 0:
                    i = bisect_right(starts, p) - 1
                    rows.add(i)
                    p = low.find(v, ends[i])
            for i in rows:
                out[i].append(k)
        return out

    def run(a: pa.Array) -> pa.Array:
        import numpy as np

        parts = []
        for texts in slices(a):
            known = [t or b"" for t in texts]
            sizes = np.fromiter(map(len, known), np.int64, len(known))
            starts = np.cumsum(sizes + 1) - sizes
            joined = sep + sep.join(known) + sep
            c = np.frombuffer(joined.translate(classes), np.uint8)
            begins = c[1:] & ~c[:-1]
            total = lambda x: np.add.reduceat(x, starts - 1, dtype=np.int64)  # noqa: B023, E731
            # the white space that follows a sentence's end, from its first byte to its last
            space = (c & SPACE) != 0
            edges = np.flatnonzero(space[1:] != space[:-1]) + 1
            first, after = edges[::2], edges[1::2]
            next_ = after[(c[first - 1] & END) != 0]
            marks = np.flatnonzero(c & MARK)[:-1] + 1
            pieces = np.concatenate([x[(c[x] & MARK) == 0] for x in (next_, marks)])
            s = np.bincount(np.searchsorted(starts, pieces, "right") - 1, minlength=len(known))
            none = np.fromiter((t is None for t in texts), bool, len(texts))
            number = lambda x: pa.array(x.astype(np.int32), pa.int32(), mask=none)  # noqa: B023, E731
            counts = [number(x) for x in (s, total(begins & WORD), total((begins & VOWEL) >> 1), total((c[1:] & FIRST) >> 5))]
            parts.append(pa.StructArray.from_arrays([*counts, pa.array(held(known, joined, starts.tolist()), pa.list_(pa.string()))], ["s", "w", "y", "l", "categories"]))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    kind = pa.struct([*((n, pa.int32()) for n in "swyl"), ("categories", pa.list_(pa.string()))])
    return F.arrow_udf(run, "struct<s:int,w:int,y:int,l:int,categories:array<string>>")(text)


def top_word_hits(text: Column, k: int, stop: tuple[str, ...], least: int = 3) -> Column:
    """struct<words, hits> of a text: its words between white space, and how often its ``k`` most frequent alphabetic words of ``least`` letters or more, less ``stop`` (ties: first in order), occur in the lower-cased text, also within others."""
    pattern, less = b"[a-z]{%d,}" % least, frozenset(w.encode() for w in stop)
    slices, lower = _slices(), _lower()

    def run(a: pa.Array) -> pa.Array:
        import re
        from collections import Counter
        from heapq import nsmallest

        each = re.compile(pattern)

        def hits(t: bytes) -> int:
            t = lower(t)
            n = Counter(each.findall(t))
            return sum(t.count(w) for _, w in nsmallest(k, ((-c, w) for w, c in n.items() if w not in less)))

        rows = [None if t is None else {"words": len(t.split()), "hits": hits(t)} for texts in slices(a) for t in texts]
        return pa.array(rows, pa.struct([("words", pa.int32()), ("hits", pa.int32())]))

    return F.arrow_udf(run, "struct<words:int,hits:int>")(text)
