"""SentencePiece encoding and decoding in batched numpy.

A text gets a leading space, spaces become the meta symbol, and the result is cut where no
piece of the vocabulary can reach across: before runs of meta symbols and around characters
that only single-character pieces hold. Distinct words of a batch are dealt by length and
words of equal length advance together, by a Viterbi search: at each position, substring
hashes (polynomial, by prefix sums) probe the sorted hashes of the pieces, hits are compared
with the pieces themselves, and the vectorised maximum over starts is stored with its
backpointer.

In ``unigram`` models a start's value is the best path's score. ``bpe`` models carry merge
priorities, of which the best sum of scores is not the library's result. There a path is one
of neighbours that merging leaves as they are: a word's encoding is the only one of its
segmentations in which every two neighbours are, merged by themselves, those two again. So a
start is worth 0 if its piece may follow the piece before it and is excluded if not, and one
start remains at each position. Which pieces may be neighbours is found by merging the two,
batched as well, once for each pair a worker meets; at most ``PAIRS`` of them are remembered.
Characters without a piece are spelled in byte pieces.

Defined results: null and empty texts have no ids; ids decode to the text itself, but for
meta symbols in the text, which come back as spaces (``round_trip`` false); words of over
``LONG`` characters take a plain search, with the same result; the cache of words holds at
most twice ``CACHE`` entries and those of a block. A model with a normaliser or other settings of spaces than these is
refused. Repeated rows give a row each; other columns pass through untouched, but for those
named as a result, which are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ship

META = "▁"
#: Longest word for the batched search.
LONG = 256
#: Words whose ids are remembered in a worker; those met since the cache last filled up stay.
CACHE = 120_000
#: Characters of words searched at once, and of texts cut into words at once.
BATCH, BLOCK = 1 << 18, 2_000_000
#: Pairs of neighbours remembered in a worker.
PAIRS = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
NEVER = -np.inf
#: What stands before a word's first piece.
START = (1 << 31) - 1


def default_model() -> str:
    """The public vocabulary file used by the query; a cluster passes its own path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(model_file: str) -> dict:
    """The model's pieces in a plain form that can be broadcast."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(model_file, "rb") as f:
        proto.ParseFromString(f.read())
    kinds = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 5: "unused", 6: "byte"}
    assert sentencepiece
    n, t = proto.normalizer_spec, proto.trainer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or t.treat_whitespace_as_suffix:
        raise ValueError(f"{model_file}: a model with a normaliser or with other settings of spaces")
    if t.model_type not in (1, 2) or any(p.type == 4 for p in proto.pieces):
        raise ValueError(f"{model_file}: a model of another kind, or with pieces defined by the user")
    pieces = [(p.piece, p.score, kinds[p.type]) for p in proto.pieces]
    return {"pieces": pieces, "kind": {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Vocabulary:
    """Pieces by id, and the sorted hashes of the normal ones with their scores and ids."""

    def __init__(self, pieces: Sequence[tuple[str, float, str]], kind: str):
        self.kind = kind
        normal = [(p, s, i) for i, (p, s, k) in enumerate(pieces) if k == "normal"]
        self.ids = {p: i for p, _, i in normal}
        self.scores = {p: s for p, s, _ in normal}
        self.longest = max((len(p) for p, _, _ in normal), default=1)
        self.powers = np.ones(LONG + 2, np.uint64)
        np.multiply.accumulate(np.full(LONG + 1, _P), out=self.powers[1:])
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == "unknown"), 0)
        self.bytes = np.full(256, self.unknown, np.int32)
        self.spelled = [b""] * len(pieces)
        for i, (p, _, k) in enumerate(pieces):
            if k == "byte":
                self.bytes[int(p[1:-1], 16)] = i
                self.spelled[i] = bytes([int(p[1:-1], 16)])
            elif k == "normal":
                self.spelled[i] = p.replace(META, " ").encode()
            elif k == "unknown":
                self.spelled[i] = " ⁇ ".encode()
        hashes = np.array([self._hash(p) for p, _, _ in normal], np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.key_scores = np.array([s for _, s, _ in normal])[order]
        self.key_ids = np.array([i for _, _, i in normal], np.int32)[order]
        assert len(np.unique(self.keys)) == len(self.keys)
        chars = np.zeros((len(normal), self.longest), np.uint32)
        for k, (p, _, _) in enumerate(normal):
            chars[k, : len(p)] = [ord(c) for c in p]
        self.key_chars = chars[order]
        # hashes of all beginnings of pieces: where a substring is none, no longer one from there is a piece
        heads = {p[:k] for p, _, _ in normal for k in range(1, len(p) + 1)}
        head_hashes = np.array([self._hash(p) for p in heads], np.uint64)
        by = np.argsort(head_hashes)
        self.heads = head_hashes[by]
        place = {p: k for k, p in enumerate(normal[i][0] for i in order.tolist())}
        self.head_pieces = np.array([place.get(p, -1) for p in heads], np.int32)[by]
        # a piece by id, or a character without one by its code point after the ids
        self.n_ids = len(pieces)
        self.strings = [p for p, _, _ in pieces]
        self._forget_pairs()
        # characters inside longer pieces; the others stand alone
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        assert not any(META in p.lstrip(META) for p in self.ids), "a piece reaches across words"
        alone = "".join(map(re.escape, sorted(c for c in map(chr, range(33)) if c not in inside and c != " ")))
        self.cut = re.compile(f"[{alone}]| *[^ {alone}]+| +") if alone else re.compile(" *[^ ]+| +")
        # a score below any word's for characters that no piece holds
        self.missing = min(self.key_scores, default=0.0) - 10.0
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _hash(self, piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _P + np.uint64(ord(c) + 1)
            return _mix(np.array([h]))[0]

    def probe(self, prefix: np.ndarray, row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores of the substrings [i, j) of words in ``row``; -inf where there is no such piece."""
        h = _mix(prefix[row, j] - prefix[row, i] * self.powers[j - i])
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        ok = (self.keys[at] == h) & (j - i <= self.longest)
        return np.where(ok, self.key_scores[at], NEVER)

    def _spell(self, char: str) -> list[int]:
        return self.bytes[list(char.replace(META, " ").encode())].tolist() if char != META else self.bytes[list(META.encode())].tolist()

    def _prefixes(self, words: list[str]) -> np.ndarray:
        x = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((len(words), x.shape[1] + 1), np.uint64)
        for k in range(x.shape[1]):
            prefix[:, k + 1] = prefix[:, k] * _P + x[:, k]
        return prefix

    def _pieces_at(self, x: np.ndarray, prefix: np.ndarray, rows: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``rows``: those whose characters [i, j) begin a piece, those where they are one, and its places in the sorted keys."""
        h = _mix(prefix[rows, j] - prefix[rows, i] * self.powers[j - i])
        at = np.searchsorted(self.heads, h)
        at[at == len(self.heads)] = 0
        hit = self.heads[at] == h
        alive, at = rows[hit], self.head_pieces[at[hit]]
        known = at >= 0
        rows, at = alive[known], at[known]
        # equal hashes are compared, and the piece must end where the substring does
        same = (self.key_chars[at, : j - i] == x[rows, i:j]).all(1)
        if j - i < self.longest:
            same &= self.key_chars[at, j - i] == 0
        return alive, rows[same], at[same]

    def _forget_pairs(self) -> None:
        """Known pairs are kept sorted, the newest apart: they join the others once they are many, so a pair is moved few times."""
        self.pair_keys, self.pair_ok = np.empty(0, np.int64), np.empty(0, bool)
        self.new_keys, self.new_ok = np.empty(0, np.int64), np.empty(0, bool)

    @staticmethod
    def _known(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' places in a sorted table, and whether they are there."""
        at = np.searchsorted(table, keys)
        at[at == len(table)] = 0
        return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)

    def _follows(self, keys: np.ndarray) -> np.ndarray:
        """Whether the second token of each pair (first << 32 | second) may follow the first."""
        out = np.zeros(len(keys), bool)
        at, old = self._known(self.pair_keys, keys)
        out[old] = self.pair_ok[at[old]]
        if old.all():
            return out
        rest = np.flatnonzero(~old)
        at, there = self._known(self.new_keys, keys[rest])
        out[rest[there]] = self.new_ok[at[there]]
        rest = rest[~there]
        if not len(rest):
            return out
        todo, own = np.unique(keys[rest], return_inverse=True)
        ok = self._neighbours(todo)
        out[rest] = ok[own]
        if len(self.pair_keys) + len(self.new_keys) + len(todo) > PAIRS:
            self._forget_pairs()
        at = np.searchsorted(self.new_keys, todo)
        self.new_keys, self.new_ok = np.insert(self.new_keys, at, todo), np.insert(self.new_ok, at, ok)
        if len(self.new_keys) > 4096 + len(self.pair_keys) // 8:
            at = np.searchsorted(self.pair_keys, self.new_keys)
            self.pair_keys, self.pair_ok = np.insert(self.pair_keys, at, self.new_keys), np.insert(self.pair_ok, at, self.new_ok)
            self.new_keys, self.new_ok = np.empty(0, np.int64), np.empty(0, bool)
        return out

    def _string(self, token: int) -> str:
        return "" if token == START else self.strings[token] if token < self.n_ids else chr(token - self.n_ids)

    def _neighbours(self, keys: np.ndarray) -> np.ndarray:
        """For new pairs: whether merging their text gives the two again."""
        out = np.ones(len(keys), bool)
        by: dict[int, list[tuple[int, str, int]]] = {}
        for k, key in enumerate(keys.tolist()):
            u, t = self._string(key >> 32), self._string(key & 0xFFFFFFFF)
            if len(u + t) > 1:
                by.setdefault(len(u + t), []).append((k, u + t, len(u)))
        for group in by.values():
            for (k, _, at), cut in zip(group, self._merged([w for _, w, _ in group]), strict=True):
                out[k] = cut[1:-1] == ([at] if at else [])
        return out

    def _search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of equal length: backpointers (words x positions), and the token that ends at each position."""
        n, w, prefix = len(words[0]), len(words), self._prefixes(words)
        x = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(w, n)
        best, back = np.full((w, n + 1), NEVER), np.zeros((w, n + 1), np.int32)
        last = np.full((w, n + 1), START, np.int64)
        best[:, 0] = 0
        alive = [np.arange(w)] * n
        for j in range(1, n + 1):
            rows, starts, tokens = [], [], []
            for i in range(max(0, j - self.longest), j):
                if not len(alive[i]):
                    continue
                alive[i], r, at = self._pieces_at(x, prefix, alive[i], i, j)
                t, s = self.key_ids[at].astype(np.int64), self.key_scores[at]
                if i == j - 1 and len(r) < w:  # a character without a piece stands for itself
                    alone = np.ones(w, bool)
                    alone[r] = False
                    alone = np.flatnonzero(alone)
                    r, t, s = np.concatenate((r, alone)), np.concatenate((t, x[alone, i].astype(np.int64) + self.n_ids)), np.concatenate((s, np.full(len(alone), self.missing)))
                if self.kind == "bpe":
                    rows.append(r)
                    starts.append(np.full(len(r), i, np.int32))
                    tokens.append(t)
                    continue
                s = s + best[r, i]
                better = s > best[r, j]
                r = r[better]
                best[r, j], back[r, j], last[r, j] = s[better], i, t[better]
            if self.kind == "bpe":
                r, i, t = (np.concatenate(v) for v in (rows, starts, tokens))
                # the maximum of 0 for what may follow and -inf for the rest: one start is left of each word
                ok = self._follows(last[r, i] << 32 | t)
                r = r[ok]
                best[r, j], back[r, j], last[r, j] = 0, i[ok], t[ok]
        assert np.isfinite(best[:, n]).all()
        return back, last

    def _viterbi(self, words: list[str]) -> list[list[tuple[int, int]]]:
        """Words of equal length: their best segmentations as (start, end); ties go to the longest piece."""
        return [list(zip(cuts, cuts[1:], strict=False)) for cuts in self._trace(self._search(words)[0])]

    def _packed(self, words: list[str]) -> list[bytes]:
        """Words of equal length: their packed ids, all traced back together."""
        back, last = self._search(words)
        w, n = back.shape[0], back.shape[1] - 1
        ids, at, rows = np.zeros((w, n), "<i4"), np.full(w, n), np.arange(w)
        begin, odd = np.full(w, n), np.zeros(w, bool)
        for k in range(n - 1, -1, -1):
            t = last[rows, at]
            ids[rows, k] = t
            odd[rows] |= t >= self.n_ids
            begin[rows] = k
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
            if not len(rows):
                break
        data, begin = ids.tobytes(), begin.tolist()
        out = [data[4 * (n * r + b) : 4 * n * (r + 1)] for r, b in enumerate(begin)]
        for r in np.flatnonzero(odd).tolist():  # characters without a piece are spelled in bytes
            cuts = self._trace(back[r : r + 1])[0]
            out[r] = self._ids(words[r], list(zip(cuts, cuts[1:], strict=False)))
        return out

    @staticmethod
    def _trace(back: np.ndarray) -> list[list[int]]:
        """The cuts of each word, from the backpointers."""
        out = []
        for row in back.tolist():
            cuts = [len(row) - 1]
            while cuts[-1]:
                cuts.append(row[cuts[-1]])
            out.append(cuts[::-1])
        return out

    def _merged(self, words: list[str]) -> list[list[int]]:
        """Words of equal length of two or more: their cuts after all merges, the leftmost best-scored pair first."""
        n, prefix = len(words[0]), self._prefixes(words)
        out: list[list[int]] = [[]] * len(words)
        row = np.arange(len(words))
        cut = np.tile(np.arange(n + 1), (len(words), 1))
        pair = np.full((len(words), n - 1), NEVER)
        for k in range(n - 1):
            pair[:, k] = self.probe(prefix, row, cut[:, k], cut[:, k + 2])
        while len(row):
            m = cut.shape[1] - 1
            at = pair.argmax(1) if m > 1 else np.zeros(len(row), np.int64)
            go = pair[np.arange(len(row)), at] > NEVER if m > 1 else np.zeros(len(row), bool)
            if not go.all():
                for r, c in zip(row[~go].tolist(), cut[~go].tolist(), strict=True):
                    out[r] = c
            if not go.any():
                break
            row, cut, pair, at = row[go], cut[go], pair[go], at[go]
            k = np.arange(len(row))
            keep = np.ones(cut.shape, bool)
            keep[k, at + 1] = False
            cut = cut[keep].reshape(len(row), m)
            keep = np.ones(pair.shape, bool)
            keep[k, at] = False
            pair = pair[keep].reshape(len(row), m - 2)
            left, right = at > 0, at < m - 2
            if left.any():
                a = at[left]
                pair[k[left], a - 1] = self.probe(prefix, row[left], cut[k[left], a - 1], cut[k[left], a + 1])
            if right.any():
                a = at[right]
                pair[k[right], a] = self.probe(prefix, row[right], cut[k[right], a], cut[k[right], a + 2])
        return out

    def _viterbi_long(self, word: str) -> list[tuple[int, int]]:
        """One word, position by position, for words too long to batch."""
        n = len(word)
        best, back, last = [0.0] + [NEVER] * n, [0] * (n + 1), [START] * (n + 1)
        known: dict[int, bool] = {}

        def follows(u: int, t: int) -> bool:
            key = u << 32 | t
            if key not in known:
                known[key] = bool(self._follows(np.array([key]))[0])
            return known[key]

        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                t = self.ids.get(word[i:j])
                if t is None and i < j - 1:
                    continue
                s = self.scores[word[i:j]] if t is not None else self.missing
                t = ord(word[i]) + self.n_ids if t is None else t
                if self.kind == "bpe":
                    s = 0.0 if best[i] > best[j] and follows(last[i], t) else NEVER
                if s + best[i] > best[j]:
                    best[j], back[j], last[j] = s + best[i], i, t
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        return list(zip(cuts[:0:-1], cuts[-2::-1], strict=True))

    def _ids(self, word: str, segments: list[tuple[int, int]]) -> bytes:
        ids: list[int] = []
        for i, j in segments:
            known = self.ids.get(word[i:j])
            ids += [known] if known is not None else self._spell(word[i])
        return np.array(ids, "<i4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Puts the ids of the words (meta symbols in place) into the cache."""
        by: dict[int, list[str]] = {}
        for w in words:
            if (known := self.older.get(w)) is not None:
                self.cache[w] = known
            else:
                by.setdefault(len(w), []).append(w)
        for n, group in by.items():
            if n == 1:
                self.cache.update((w, self._ids(w, [(0, 1)])) for w in group)
            elif n > LONG:
                self.cache.update((w, self._ids(w, self._viterbi_long(w))) for w in group)
            else:
                step = max(1, BATCH // n)
                for i in range(0, len(group), step):
                    part = group[i : i + step]
                    self.cache.update(zip(part, self._packed(part), strict=True))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as packed little-endian 32-bit integers."""
        out = []
        block: list[list[str]] = []
        new: set[str] = set()
        size = 0

        def flush() -> None:
            nonlocal block, new, size
            self.learn(new)
            get = self.cache.__getitem__
            out.extend(b"".join(map(get, b)) for b in block)
            block, new, size = [], set(), 0
            if len(self.cache) > CACHE:
                self.older, self.cache = self.cache, {}

        for t in texts:
            words = self.cut.findall(f" {t}".replace(META, " ")) if t else []
            words = [w.replace(" ", META) for w in words]
            block.append(words)
            new.update(w for w in words if w not in self.cache)
            size += len(t)
            if size > BLOCK:
                flush()
        flush()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, without the leading space that encoding adds."""
        spelled = self.spelled
        data = b"".join([spelled[i] for i in np.frombuffer(ids, "<i4").tolist()])
        return data.decode("utf-8", "replace").removeprefix(" ")


#: Columns that ``round_trip`` makes.
RESULTS = ("token_ids", "n_tokens", "round_trip")
_built: dict[str, Vocabulary] = {}


def _vocabulary(told, mark: str) -> Vocabulary:
    if mark not in _built:
        _built.clear()
        _built[mark] = Vocabulary(**told.value)
    return _built[mark]


def encode(docs: DataFrame, pieces: dict, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with packed ids (little-endian 32-bit) in ``out``."""
    ship(docs.sparkSession)
    told, mark = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series(_vocabulary(told, mark).encode(texts.fillna("").tolist()), dtype=object)

    return docs.withColumn(out, encoded(F.col(text).cast("string")))


def decode(df: DataFrame, pieces: dict, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of packed ids in ``out``."""
    ship(df.sparkSession)
    told, mark = df.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    @F.pandas_udf("string")
    def decoded(packed: pd.Series) -> pd.Series:
        v = _vocabulary(told, mark)
        return pd.Series([v.decode(b"" if p is None else bytes(p)) for p in packed], dtype=object)

    return df.withColumn(out, decoded(F.col(ids)))


def round_trip(docs: DataFrame, pieces: dict, text: str = "text") -> DataFrame:
    """``docs`` with token_ids (packed), n_tokens, and round_trip: whether the ids decode to the text."""
    ship(docs.sparkSession)
    told, mark = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    @F.pandas_udf("ids binary, same boolean")
    def there_and_back(texts: pd.Series) -> pd.DataFrame:
        v, texts = _vocabulary(told, mark), texts.fillna("").tolist()
        ids = v.encode(texts)
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "same": [v.decode(i) == t for i, t in zip(ids, texts, strict=True)]})

    made = "__quarry_ids"
    df = docs.withColumn(made, there_and_back(F.col(text).cast("string")))
    ids = F.col(made)["ids"]
    kept = [c for c in docs.columns if c not in RESULTS]
    return df.select(*(F.col(f"`{c}`") for c in kept), ids.alias("token_ids"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.col(made)["same"].alias("round_trip"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """Every text of ``documents`` encoded and decoded; ids as the SHA-256 of their packed form."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = round_trip(docs, load_pieces(model_file or default_model()))
    return r.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), "round_trip")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents without their text, with packed token ids."""
    return round_trip(docs, load_pieces(default_model())).drop("text")
