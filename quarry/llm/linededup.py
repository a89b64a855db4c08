"""Line dedup: an exact set-similarity join of lines, of which later matches are removed.

A line's set holds its distinct lower-cased words (split at space, tab, vertical tab, form
feed and carriage return). Words are counted in ``BUCKETS`` buckets over all documents; a
word's order is the size class of its bucket, rare first, then its hash. Lines with equal
sets are one class, placed at its first line. A class is removed if an earlier class (by
document id, document, line number) has a Jaccard similarity of num / den or more with it;
of a class, only the first line can stay.

Candidates share a word of their prefixes in that order and pass the length filter, the
positional filter and a bitmap filter (parities of words by bit can't differ in more bits
than the sets differ in words). The similarity of what remains is verified on the words
themselves. Most copies are found early: each class is first compared with the earliest
class that shares one of three signatures, and only classes that this doesn't remove look
through the prefixes of all earlier classes, so a large group of near copies isn't compared
pair by pair.

Native DataFrame expressions throughout. The order is one byte per bucket, whatever the
input: a bounded literal. With so many different words that buckets hold several, words
counted more often than a bucket's share still come last; the result doesn't depend on it.

Defined results: a null text stays null; lines without words stay and match nothing; rows
with equal id and text are one document and get the same result; null ids come first; ties
in similarity don't matter, as one earlier match is enough; an empty table gives no rows;
other columns pass through untouched. Sets are equal if two 64-bit hashes of their words'
hashes and the 128 parities are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import forget, lookup_join, release, staged

#: Jaccard similarity, as a fraction, from which a later line is removed.
NUM, DEN = 80, 100
BUCKET_BITS = 19
BUCKETS = 1 << BUCKET_BITS
#: Size classes of buckets in each doubling of their counts.
STEPS = 3
#: Keys that may be broadcast to pick rows.
PICK_ROWS = 200_000
#: What separates words, besides the space and the end of the line.
_GAPS = "\t\x0b\f\r"


def _pieces(text: Column) -> Column:
    """Lower-cased words of a text, with empty ones between neighbouring spaces.

    Cutting at one literal space spares most texts the regular expression.
    """
    rare = F.contains(text, F.lit(_GAPS[0]))
    for c in _GAPS[1:]:
        rare |= F.contains(text, F.lit(c))
    return F.split(F.lower(F.when(rare, F.translate(text, _GAPS, "    ")).otherwise(text)), " ")


def words_of(line: Column) -> Column:
    """The distinct words of a line, in order of appearance."""
    return F.array_remove(F.array_distinct(_pieces(line)), "")


def hashes_of(line: Column) -> Column:
    """The hashes of a line's distinct words; they are made distinct as numbers, not as strings."""
    h = F.array_distinct(F.transform(_pieces(line), lambda w: F.xxhash64(w)))
    return F.array_remove(h, F.xxhash64(F.lit("")))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row (did, doc, pos, line) for each line; ``doc`` is a hash of id and text, made before the lines are."""
    whole = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("did"), F.xxhash64(F.col(key), F.col(text)).alias("doc"), F.split(F.col(text), "\n", -1).alias("lines"))
    return whole.select("did", "doc", F.posexplode("lines").alias("pos", "line"))


def word_order(docs: DataFrame, text: str) -> Column:
    """The size class of each bucket of words, as a literal of one byte per bucket."""
    w = docs.select(F.explode(_pieces(F.replace(F.col(text), F.lit("\n"), F.lit(" ")))).alias("w")).where("w <> ''")
    counts = w.groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).count()
    size = F.least(F.lit(94), F.floor(STEPS * F.log2(F.col("count").cast("double")))).cast("int")
    # a row holds the buckets of equal low bits, so the driver gets few and short rows
    rows = counts.select(F.col("b").bitwiseAND(1023).alias("g"), "b", F.char(size + 32).alias("s")).groupBy("g").agg(F.collect_list(F.struct("b", "s")).alias("l"))
    rows = rows.select(F.array_join(F.transform("l", lambda x: x["b"].cast("string")), ",").alias("bs"), F.array_join(F.transform("l", lambda x: x["s"]), "").alias("ss"))
    sizes = bytearray(b" " * BUCKETS)
    for r in rows.collect():
        for b, s in zip(map(int, r["bs"].split(",")), r["ss"], strict=True):
            sizes[b] = ord(s)
    return F.lit(bytes(sizes))


def classes_of(docs: DataFrame, key: str, text: str, num: int, den: int) -> DataFrame:
    """A row per class of lines with equal word sets: cid, at (its first line), n, prefix, b1 and b2, sigs."""
    sizes = word_order(docs, text)

    def rank(h: Column) -> Column:
        size = F.ascii(F.substring(sizes, h.bitwiseAND(BUCKETS - 1).cast("int") + 1, F.lit(1)).cast("string"))
        return F.shiftleft(size.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    one = F.lit(1).cast("long")
    bit = lambda h: F.call_function("shiftleft", one, h.bitwiseAND(63).cast("int"))
    # the parities of the words by the last seven bits of their hashes, which the order leaves out, in two halves
    half = lambda k: lambda a, h: F.when(h.bitwiseAND(64) == k, a.bitwiseXOR(bit(h))).otherwise(a)
    l = lines_of(docs, key, text).withColumn("h", hashes_of(F.col("line"))).drop("line")
    n = F.size("h")
    zero = F.lit(0).cast("long")
    l = l.select("did", "doc", "pos", n.alias("n"), F.sort_array(F.transform("h", rank)).alias("keys"), F.array_min("h").alias("low"), F.aggregate("h", zero, half(0)).alias("b1"), F.aggregate("h", zero, half(64)).alias("b2"))
    prefix = F.slice("keys", F.lit(1), F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("int") + 1)
    # 31 bits of a word's hash are enough to find candidates
    prefix = F.transform(prefix, lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int"))
    # a min-hash, the eight most frequent words, and the eight before them
    last = lambda a, b: F.xxhash64(F.slice("keys", F.greatest(F.col("n") - a, F.lit(1)), F.lit(b)))
    sigs = F.array(F.col("low"), last(7, 8), last(15, 8))
    l = l.select("did", "doc", "pos", F.xxhash64("keys").alias("c1"), F.xxhash64(F.lit(1), "keys").alias("c2"), "n", prefix.alias("prefix"), "b1", "b2", sigs.alias("sigs"))
    c = l.groupBy("c1", "c2", "b1", "b2").agg(F.min(F.struct("did", "doc", "pos")).alias("at"), *(F.first(x).alias(x) for x in ("n", "prefix", "sigs")))
    # only here: a filter on the words themselves would have them made twice; once staged, the short ids are fixed
    return c.drop("c1", "c2").where("n > 0").withColumn("cid", F.monotonically_increasing_id())


def _near(num: int, den: int) -> Column:
    """Length filter and bitmap filter on (n, b1, b2) and (nx, b1x, b2x)."""
    a, b = F.col("n"), F.col("nx")
    # differing words <= (den - num) / (den + num) of both sizes together
    apart = F.bit_count(F.col("b1").bitwiseXOR(F.col("b1x"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("b2x")))
    return (den * a >= num * b) & (den * b >= num * a) & (apart * (den + num) <= (den - num) * (a + b))


def verified(docs: DataFrame, pairs: DataFrame, key: str, text: str, num: int, den: int) -> DataFrame:
    """The distinct ``later`` classes of ``pairs`` (later, earlier, at, atx) whose words are similar enough."""
    ids = pairs.select(F.col("later").alias("cid"), "at").union(pairs.select(F.col("earlier").alias("cid"), F.col("atx").alias("at"))).dropDuplicates(["cid"])
    # a document's needed lines together, so that its text is cut once
    need = ids.groupBy(F.col("at.did").alias("did"), F.col("at.doc").alias("doc")).agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "cid")).alias("want"))
    need = staged(need, "need")
    small = need.count() <= PICK_ROWS
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("own"), F.xxhash64(F.col(key), F.col(text)).alias("doc"), F.col(text).alias("text"))
    both = own.join(F.broadcast(need) if small else need, "doc").where(F.col("own").eqNullSafe(F.col("did")))
    bound = F.struct(F.split("text", "\n", -1).alias("lines"), F.col("want").alias("want"))
    lines = F.transform(F.array(bound), lambda s: F.transform(s["want"], lambda q: F.struct(q["cid"].alias("cid"), F.get(s["lines"], q["pos"]).alias("line"))))[0]
    words = both.select(F.explode(lines).alias("x")).select("x.cid", words_of(F.col("x.line")).alias("w"))
    # repeated rows of a document give its lines again
    words = staged(words, "words").dropDuplicates(["cid"])
    p = pairs.select("later", "earlier").join(words.select(F.col("cid").alias("later"), F.col("w").alias("w1")), "later").join(words.select(F.col("cid").alias("earlier"), F.col("w").alias("w2")), "earlier")
    shared = F.size(F.array_intersect("w1", "w2"))
    return p.where(shared * den >= num * (F.size("w1") + F.size("w2") - shared)).select(F.col("later").alias("cid")).distinct()


def removed_classes(docs: DataFrame, classes: DataFrame, key: str, text: str, num: int, den: int) -> DataFrame:
    """cid of each class that an earlier one is similar to."""
    # first by signature, against the earliest class of each
    g = classes.select("cid", "at", "n", "b1", "b2", F.posexplode("sigs").alias("j", "sig")).withColumn("key", F.xxhash64("j", "sig")).drop("j", "sig")
    heads = g.groupBy("key").agg(F.min(F.struct("at", "cid", "n", "b1", "b2")).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1")
    heads = heads.select("key", F.col("h.at").alias("atx"), F.col("h.cid").alias("earlier"), *(F.col(f"h.{c}").alias(f"{c}x") for c in ("n", "b1", "b2")))
    # a signature that very many classes share is split by the adaptive skew join; salting would repeat every head
    first = lookup_join(g, heads, "key", F.col("cid"), salts=1).where((F.col("earlier") != F.col("cid")) & _near(num, den))
    first = staged(first.select(F.col("cid").alias("later"), "earlier", "at", "atx").dropDuplicates(["later", "earlier"]), "pairs")
    done = staged(verified(docs, first, key, text, num, den).withColumn("done", F.lit(True)), "removed")
    forget(first)

    # then the rest by prefixes, against all other classes; both sides of the join read one shuffle
    x = lookup_join(classes.select("cid", "n", "b1", "b2", "prefix"), done, "cid", F.col("n"), salts=1, max_rows=PICK_ROWS)
    x = x.select("cid", "b1", "b2", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.coalesce(F.col("done"), F.lit(False)).cast("long")).alias("m"), F.posexplode("prefix").alias("p", "word"))
    # size, position and whether it is removed already, in one number
    x = x.select("word", "cid", F.col("m").bitwiseOR(F.shiftleft(F.col("p").cast("long"), 1)).alias("m"), "b1", "b2")
    # both are renamed: a shuffle is read twice only if its two plans are alike, and a column isn't like a renamed one
    x, r = (x.select("word", *(F.col(c).alias(f"{c}{side}") for c in ("cid", "m", "b1", "b2"))) for side in ("y", "x"))
    size = lambda m: F.shiftright(m, 32).cast("int")
    at = lambda m: F.shiftright(m, 1).bitwiseAND(0x7FFFFFFF).cast("int")
    m, mx = F.col("my"), F.col("mx")
    n, nx = size(m), size(mx)
    # within a pair, some common word has no more words before it than either set can miss
    most = F.least(n - at(m), nx - at(mx))
    apart = F.bit_count(F.col("b1y").bitwiseXOR(F.col("b1x"))) + F.bit_count(F.col("b2y").bitwiseXOR(F.col("b2x")))
    ok = (F.col("cidy") < F.col("cidx")) & (den * n >= num * nx) & (den * nx >= num * n) & (most * (num + den) >= num * (n + nx))
    ok &= (apart * (den + num) <= (den - num) * (n + nx)) & (m.bitwiseAND(mx).bitwiseAND(1) == 0)
    rest = staged(x.join(r, "word").where(ok).select(F.col("cidy").alias("a"), F.col("cidx").alias("b"), m.bitwiseAND(1).alias("da"), mx.bitwiseAND(1).alias("db")).distinct(), "pairs")
    release(docs.sparkSession)
    place = classes.select("cid", "at")
    found = rest.join(place.select(F.col("cid").alias("a"), F.col("at").alias("ata")), "a").join(place.select(F.col("cid").alias("b"), F.col("at").alias("atb")), "b")
    swap = F.col("ata") < F.col("atb")
    either = lambda p, q: F.when(swap, F.col(p)).otherwise(F.col(q))
    found = found.where(either("db", "da") == 0).select(either("b", "a").alias("later"), either("a", "b").alias("earlier"), either("atb", "ata").alias("at"), either("ata", "atb").alias("atx"))
    found = staged(found, "pairs")
    forget(rest)
    return staged(done.select("cid").union(verified(docs, found, key, text, num, den)), "removed")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the later matches among their lines removed from the text.

    ``counts`` names two columns to add: the lines of each text, and those removed.
    """
    classes = staged(classes_of(docs, key, text, num, den), "classes")
    release(docs.sparkSession)
    gone = removed_classes(docs, classes, key, text, num, den).withColumn("gone", F.lit(True))
    # what stays of each document: its lines that are the first of a class that stays
    first = lookup_join(classes.select("cid", "at"), gone, "cid", F.col("at.pos"), salts=1, max_rows=PICK_ROWS).where("gone IS NULL")
    kept = first.groupBy(F.col("at.did").alias("__quarry_id"), F.col("at.doc").alias("__quarry_doc")).agg(F.collect_list("at.pos").alias("__quarry_kept"))
    kept = staged(kept, "kept")
    forget(classes, gone)
    same = (F.col("__quarry_doc") == F.col("__quarry_own")) & F.col("__quarry_id").eqNullSafe(F.col(key))
    d = docs.withColumn("__quarry_own", F.xxhash64(F.col(key), F.col(text))).join(kept, same, "left")
    n = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    whole = F.coalesce(F.size("__quarry_kept"), F.lit(0)) == n
    gaps = " " + _GAPS

    def left(s: Column) -> Column:
        """The lines that stay, from (all lines, places of kept lines): those and the lines without words."""
        wordless = F.filter(F.transform(s["all"], lambda x, i: F.when(F.btrim(x, F.lit(gaps)) == "", i)), lambda i: i.isNotNull())
        places = F.array_sort(F.concat(s["kept"], wordless))
        return F.struct(F.size(places).alias("n"), F.array_join(F.transform(places, lambda i: F.get(s["all"], i)), "\n").alias("text"))

    bound = F.struct(F.split(F.col(text), "\n", -1).alias("all"), F.coalesce("__quarry_kept", F.array().cast("array<int>")).alias("kept"))
    # the lines are cut once, and only where some go or hold no words
    d = d.withColumn("__quarry_left", F.when(whole, F.struct(n.alias("n"), F.col(text).alias("text"))).when(F.col(text).isNotNull(), F.transform(F.array(bound), left)[0]))
    out = [F.col("__quarry_left.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        out += [F.coalesce(n, F.lit(0)).cast("long").alias(counts[0]), F.coalesce(n - F.col("__quarry_left.n"), F.lit(0)).cast("long").alias(counts[1])]
    return d.select(*out)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of ``documents``: what stays of each document, as a SHA-256, and the numbers of lines."""
    d = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), counts=("n_lines", "n_removed"))
    return d.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later matches of lines go, and with them documents of which no words are left; n_chars follows the text."""
    lines, removed = "__quarry_lines", "__quarry_removed"
    d = dedup_lines(docs, counts=(lines, removed)).where(~((F.col(removed) > 0) & (F.btrim("text", F.lit(" \n" + _GAPS)) == "")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


OP1_SQL = r"""
WITH l AS (SELECT doc_id, i AS pos, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, (len(string_split(text, chr(10))) + 1)::BIGINT)) AS i FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, pos, line, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[ \t\x0B\f\r]+'), lambda x: x <> ''))) AS w FROM l),
c AS (SELECT w, min((doc_id, pos)) AS place, row_number() OVER () AS cid, len(w) AS n FROM t WHERE len(w) > 0 GROUP BY w),
tok AS (SELECT cid, unnest(w) AS x FROM c),
df AS (SELECT x, count(*) AS f FROM tok GROUP BY x),
r AS (SELECT cid, tok.x, row_number() OVER (PARTITION BY cid ORDER BY f, tok.x) AS k FROM tok JOIN df ON tok.x = df.x),
p AS (SELECT r.cid, x, n FROM r JOIN c ON r.cid = c.cid WHERE k <= n - ceil(n * 80 / 100.0) + 1),
cand AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM p a JOIN p b ON a.x = b.x AND a.cid <> b.cid AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
s AS (SELECT a, b, x.place < y.place AS earlier, len(list_intersect(x.w, y.w)) AS o, x.n AS na, y.n AS nb FROM cand JOIN c x ON x.cid = a JOIN c y ON y.cid = b),
g AS (SELECT DISTINCT b AS cid FROM s WHERE earlier AND 100 * o >= 80 * (na + nb - o)),
k AS (SELECT place FROM c WHERE cid NOT IN (SELECT cid FROM g)),
keep AS (SELECT t.* FROM t LEFT JOIN k ON k.place = (t.doc_id, t.pos) WHERE len(t.w) = 0 OR k.place IS NOT NULL),
j AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS txt FROM keep GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) - coalesce(j.n, 0) END::BIGINT AS n_removed,
  length(CASE WHEN text IS NOT NULL THEN coalesce(txt, '') END)::BIGINT AS n_chars_left, sha256(CASE WHEN text IS NOT NULL THEN coalesce(txt, '') END) AS text_sha256
FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id
"""
