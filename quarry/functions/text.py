"""Column functions for text, URLs, hashes, dates and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.fixed import BOILERPLATE, ENGLISH, FORBIDDEN, HARMFUL, HINDI, PASSWORD_SYMBOLS, PHONES, SQL_PATTERNS, STOP_WORDS

# Steps of cleaning: (pattern, replacement).
CLEAN_STEPS = ((r"<[^>]+>", ""), (r"[^\p{L}\p{N}_\s.,!?;:()\-]", " "), (r"\s+", " "), (r"\s+([.,!?;:])", "$1"))
# Steps of masking: card numbers, social security numbers, e-mail addresses, ten-digit phones.
MASK_STEPS = (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", r"\b\d{3}-\d{2}-\d{4}\b", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b\d{10}\b")

def chain(c: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def clean(c: Column) -> Column:
    # most texts hold no tag, and looking for its first character is faster than for the pattern
    tags, *more = CLEAN_STEPS
    return F.trim(chain(F.when(c.contains("<"), F.regexp_replace(c, *tags)).otherwise(c), tuple(more)))


def mask(c: Column) -> Column:
    return chain(c, tuple((p, "[MASKED]") for p in MASK_STEPS))


def strip_boilerplate(c: Column) -> Column:
    return F.trim(F.regexp_replace(_less_boilerplate(F.regexp_replace(c, r"\s+", " ")), r"\s+", " "))


def _less_boilerplate(c: Column) -> Column:
    return chain(c, tuple((f"(?i){p}", "") for p in BOILERPLATE))


def without_boilerplate(c: Column) -> Column:
    """``strip_boilerplate`` of a cleaned text, whose white space is single spaces already: only what lost something is gone through again."""
    return bound(_less_boilerplate(c), lambda t: F.when(t == c, c).otherwise(F.trim(F.regexp_replace(t, r"\s+", " "))))


def tokens(c: Column) -> Column:
    """Words between white space, in lower case."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def keyword_set(c: Column, least: int = 3) -> Column:
    """Distinct words without ASCII punctuation, of ``least`` letters or more, less stop words; sorted."""
    plain = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def language(c: Column) -> Column:
    """en or hi by counts of known words; a tie above zero is hi."""
    t = tokens(c)
    en, hi = (F.size(F.filter(t, lambda w: w.isin(*words))) for words in (ENGLISH, HINDI))  # noqa: B023
    return F.when(en > hi, "en").when(hi > 0, "hi").otherwise("en")


def preview(c: Column, n: int = 500) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def truncate(c: Column, n: int, suffix: str = "...") -> Column:
    """At most ``n`` characters, the suffix included."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - len(suffix)), F.lit(suffix))).otherwise(c)


def slug(c: Column, most: int = 50) -> Column:
    s = F.regexp_replace(F.trim(F.lower(c)), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.substring(F.regexp_replace(s, r"[-\s]+", "-"), 1, most), r"^-+|-+$", "")


def file_size(n: Column, largest: str = "TB") -> Column:
    """Bytes as text in steps of 1024, up to ``largest``; exactly 0 is "0 B". A tenth's half goes to the even one, as C's printf has it."""
    units = ("B", "KB", "MB", "GB", "TB")
    units = units[: units.index(largest) + 1]
    # a double times 10 / 1024**k is a half of one only where it is exactly so: quotients by powers of two are exact
    tenths = lambda k: F.format_string("%.1f", F.rint(n / 1024**k * 10) / 10)
    out = None
    for k, unit in reversed(list(enumerate(units))):
        text = F.concat(tenths(k), F.lit(f" {unit}"))
        out = text if out is None else F.when(n < 1024 ** (k + 1), text).otherwise(out)
    return F.when(n == 0, "0 B").otherwise(out)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def strip_fragment(url: Column) -> Column:
    """Without fragment and, below the root, without trailing slashes."""
    u = F.regexp_replace(url, "#.*$", "")
    return F.when(u.endswith("/") & (F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit(""))) > 2), F.regexp_replace(u, "/+$", "")).otherwise(u)


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def is_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def is_email(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def hashed(c: Column, algorithm: str = "md5") -> Column:
    """md5, sha1 or sha256 in hex; the empty string for any other name."""
    return {"md5": F.md5(c.cast("binary")), "sha1": F.sha1(c.cast("binary")), "sha256": F.sha2(c.cast("binary"), 256)}.get(algorithm, F.lit(""))


def bound(value: Column, f) -> Column:
    """``f`` of ``value``, which is evaluated once however often ``f`` uses it."""
    return F.transform(F.array(F.struct(value.alias("v"))), lambda s: f(s["v"]))[0]


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once a row: through a generator the optimiser moves neither filters nor copies of what it makes."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def list_chunks(c: Column, size: int) -> Column:
    """Slices of ``size`` elements of an array."""
    none = F.array().cast("array<int>")
    return bound(c, lambda w: F.transform(F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size))).otherwise(none), lambda i: F.slice(w, i, F.lit(size))))


def word_chunks(c: Column, size: int = 1000) -> Column:
    """Chunks of ``size`` words joined by one space."""
    return F.transform(list_chunks(F.filter(F.split(c, r"\s+"), lambda x: x != ""), size), lambda w: F.array_join(w, " "))


def stride_chunks(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Chunks of ``size`` characters, each beginning ``overlap`` before the last one's end.

    The text is cut into steps of ``size - overlap`` characters once; a chunk is a step and the head of the next ones.
    """
    step = size - overlap
    steps = F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    more = -(-overlap // step)

    def chunks(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.concat(x, F.substring(F.array_join(F.slice(w, i + 2, F.lit(more)), ""), 1, overlap)))

    return bound(steps, chunks)


def located(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, m>>: the leftmost non-overlapping matches with their places in code points, end exclusive.

    The text between matches and the matches alternate, so sums of their lengths are the
    places; they are summed in blocks, so that many matches in one text cost little more each.
    """
    block = 128
    kind = "array<struct<start:int,end:int,m:string>>"
    none = F.expr(f"CAST(array() AS {kind})")
    by = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.arrays_zip(F.transform(F.call_function("split", text, by, F.lit(-1)), F.length).alias("gap"), F.regexp_extract_all(text, by, F.lit(0)).alias("m"))
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + p["gap"] + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), end.alias("end"), p["m"].alias("m")))).alias("out"))

    blocks = F.transform(list_chunks(F.filter(pairs, lambda p: p["m"].isNotNull()), block), lambda b: F.aggregate(b, zero, step))
    begin = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS array<{kind}>)").alias("out"))

    def join(a: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: F.struct((a["at"] + x["start"]).alias("start"), (a["at"] + x["end"]).alias("end"), x["m"].alias("m")))
        return F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(moved)).alias("out"))

    return F.when(F.call_function("rlike", text, by), F.flatten(F.aggregate(blocks, begin, join)["out"])).otherwise(none)


def map_merge(a: Column, b: Column) -> Column:
    """Both maps; where they share a key, ``b`` wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns whose names join the fields' names."""
    out = []

    def walk(schema, path: list[str]) -> None:
        for f in schema.fields:
            at = [*path, f.name]
            if f.dataType.typeName() == "struct":
                walk(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{x}`" for x in at)).alias(sep.join(at)))

    walk(df.schema, [])
    return df.select(*out)


# ---- validation: each gives the messages of what is wrong, joined by ``;``


def problems(*checks: tuple[Column, str]) -> Column:
    """The messages of the checks that hold, joined by ``;``."""
    return F.array_join(F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in checks)), lambda x: x.isNotNull()), ";")


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found, in any case."""
    return c.rlike("(?i)(" + "|".join(patterns) + ")")


def is_web_url(c: Column) -> Column:
    """Whether ``url_problems`` finds none, as one expression."""
    return c.rlike("^(?i:https?)://[^/?#]")


def url_problems(c: Column) -> Column:
    scheme = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return problems((scheme == "", "no scheme"), ((scheme != "") & (domain(c) == ""), "no domain"), ((scheme != "") & (domain(c) != "") & ~F.lower(scheme).isin("http", "https"), "scheme isn't http or https"))


def is_phone(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d+]", "").rlike("|".join(PHONES))


def password_problems(c: Column, least: int = 8) -> Column:
    return problems(
        (F.length(c) < least, "too short"), (~c.rlike("[A-Z]"), "no uppercase letter"), (~c.rlike("[a-z]"), "no lowercase letter"),
        (~c.rlike(r"\d"), "no digit"), (~c.rlike(PASSWORD_SYMBOLS), "no special character"), (c.rlike(r"\s"), "has spaces"),
    )


def file_type_problems(c: Column, allowed: tuple[str, ...]) -> Column:
    ext = F.when(c.contains("."), F.lower(F.element_at(F.split(c, r"\."), -1))).otherwise("")
    return problems((F.coalesce(c, F.lit("")) == "", "no name"), ((c != "") & (ext == ""), "no extension"), ((ext != "") & ~ext.isin(*allowed), "type not allowed"))


def file_size_problems(n: Column, most: int) -> Column:
    return problems((n <= 0, "empty"), (n > most, "too large"))


def date_range_problems(start: Column, end: Column, now: Column) -> Column:
    return problems((start >= end, "start isn't before end"), ((start < end) & (start > now), "start is in the future"))


def query_problems(c: Column) -> Column:
    """Of a search query; the first that holds."""
    t = F.trim(F.coalesce(c, F.lit("")))
    first = F.when(t == "", "empty").when(F.length(t) < 2, "too short").when(F.length(c) > 1000, "too long").when(any_of(c, HARMFUL), "harmful")
    return F.coalesce(first, F.lit(""))


def domain_query_problems(c: Column) -> Column:
    """Of a search query to the archive: stricter length, and no SQL."""
    return F.when(query_problems(c) != "", query_problems(c)).otherwise(problems((F.length(c) > 500, "too long for the archive"), (any_of(c, SQL_PATTERNS), "harmful SQL")))


def configured_query_problems(c: Column, least: int = 2, most: int = 1000) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "empty").otherwise(problems((F.length(t) < least, "too short"), (F.length(c) > most, "too long"), (any_of(c, FORBIDDEN), "forbidden")))


def tag_problems(tags: Column) -> Column:
    """Of an array of tags: more than ten, empty ones, ones over 50 characters or with other characters."""
    bad = lambda f: F.exists(tags, f)
    return problems((F.size(tags) > 10, "more than 10 tags"), (bad(lambda t: F.trim(t) == ""), "empty tag"), (bad(lambda t: F.length(t) > 50), "tag too long"), (bad(lambda t: (F.trim(t) != "") & ~t.rlike(r"^[a-zA-Z0-9\s\-_]+$")), "invalid characters"))


def bounds_problems(north: Column, south: Column, east: Column, west: Column) -> Column:
    out = lambda c, most: ~c.between(-most, most)
    return problems((out(north, 90), "north"), (out(south, 90), "south"), (out(east, 180), "east"), (out(west, 180), "west"), (north <= south, "north isn't over south"), (east <= west, "east isn't over west"))


def sanitise(c: Column) -> Column:
    """User input without tags, script urls and event handlers."""
    return F.trim(chain(c, ((r"<[^>]*>", ""), (r"(?is)<script.*?</script>", ""), (r"(?i)javascript:", ""), (r"(?i)on\w+\s*=", ""), (r"\s+", " "))))


def safe_json(c: Column, path: str) -> Column:
    """The value at ``path`` as text; null where the text isn't JSON."""
    return F.when(F.try_parse_json(c).isNotNull(), F.get_json_object(c, path))


def parse_date(c: Column, form: str = "yyyy-MM-dd") -> Column:
    """A timestamp, or null where the text has another form."""
    return F.try_to_timestamp(c, F.lit(form))


def urls_in(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
