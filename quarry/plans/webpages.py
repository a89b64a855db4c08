"""Page records and crawls: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.operators import pages as P
from quarry.plans.catalogue import load, query
from quarry.sources.staging import new_path as scratch
from quarry.sources.staging import ship

#: Entities that the pages of the tables use, for the SQL's sake.
_ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"))


def _unescape(c: str) -> str:
    for a, b in _ENTITIES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _visible(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<(script|style)\b.*?</(script|style)\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[!/A-Za-z][^>]*>', '', 'g')"
    lines = f"list_transform(string_split({_unescape(bare)}, chr(10)), lambda l: string_split(trim(l), '  '))"
    return f"array_to_string(list_filter(list_transform(flatten({lines}), lambda p: trim(p)), lambda p: p <> ''), ' ')"


_TITLE = _unescape("trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1))")


def _records(s: SparkSession, d: str, *fields: str) -> DataFrame:
    return P.records(load(s, d, "pages"), *fields)


@query(f"SELECT page_id, md5({_visible('html')}) AS digest FROM pages")
def page_visible_text(s, d):
    """Shown text: without scripts and styles, lines stripped, phrases joined by one space."""
    return _records(s, d, "visible").select("page_id", F.md5(F.col("visible").cast("binary")).alias("digest"))


_BASE = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"


@query(f"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages), a AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[^:]*:') || href WHEN starts_with(href, '/') THEN {_BASE} || href END AS link FROM h)
SELECT page_id, {_unescape('link')} AS link, count(*) AS n FROM a WHERE starts_with(link, 'http://') OR starts_with(link, 'https://') GROUP BY ALL""".replace("\\\\", "\\"))
def page_links_absolute(s, d):
    """Links resolved against the page's url; repeated ones count."""
    return _records(s, d, "links").select("page_id", F.explode("links").alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


def _cases(where: str, rules) -> str:
    return " ".join(f"WHEN {' OR '.join(f'contains(lower({where}), {w!r})' for w in words)} THEN '{k}'" for k, words in rules)


_TYPE = f"CASE {_cases('url', fixed.PAGE_TYPES_BY_URL)} {_cases('title', fixed.PAGE_TYPES_BY_TITLE)} ELSE 'general' END"
_TYPED = f"typed AS (SELECT page_id, url, html, title, {_TYPE} AS page_type FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '/products' WHEN 1 THEN url || '/FAQ' WHEN 2 THEN url || '/manual' ELSE url END AS url, html, {_TITLE} AS title FROM pages))"


def _typed(s: SparkSession, d: str) -> DataFrame:
    """The pages, some under urls of other kinds, as those of the tables are all alike."""
    k, u = F.col("page_id") % 6, F.col("url")
    more = F.when(k == 0, "/products").when(k == 1, "/FAQ").when(k == 2, "/manual").otherwise("")
    return load(s, d, "pages").select("page_id", F.concat(u, more).alias("url"), "html")


@query(f"WITH {_TYPED} SELECT page_id, page_type FROM typed")
def page_type_rules(s, d):
    """Eight rules on the url, then three on the title, in order."""
    return P.records(_typed(s, d), "page_type").select("page_id", "page_type")


@query(f"WITH {_TYPED} SELECT page_id, page_type FROM typed")
def page_type_native(s, d):
    """The same by expressions, with the title by a pattern."""
    title = F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return _typed(s, d).select("page_id", P.page_type(F.col("url"), title).alias("page_type"))


_CATEGORY = "CASE " + " ".join(f"WHEN page_type = '{k}' THEN '{v}'" for k, v in fixed.CATEGORIES_BY_PAGE.items()) + " " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{k}'" for k, w in fixed.CATEGORIES_BY_TEXT) + " ELSE 'General' END"


@query(f"WITH {_TYPED}, t AS (SELECT page_id, page_type, {_visible('html')} AS text FROM typed) SELECT page_id, {_CATEGORY} AS category FROM t")
def page_category(s, d):
    """By page type, else by words of the text, in order."""
    return P.records(_typed(s, d), "page_type", "visible").select("page_id", P.category(F.col("page_type"), F.col("visible")).alias("category"))


@query()
def page_title_description(s, d):
    """Title, and the meta description or else the first paragraph's first 200 characters."""
    return _records(s, d, "title", "description").select("page_id", "title", "description")


@query(f"""SELECT page_id, {_TITLE} AS title, coalesce({_unescape('''list_extract(regexp_extract_all(html, '<meta name="description" content="([^"]*)"', 1), -1)''')}, '') AS description, coalesce({_unescape('''list_extract(regexp_extract_all(html, '<meta name="keywords" content="([^"]*)"', 1), -1)''')}, '') AS keywords FROM pages""")
def page_metadata_last(s, d):
    """Named meta tags, of which the last counts."""
    return _records(s, d, "metadata").select("page_id", "metadata.title", "metadata.description", "metadata.keywords")


@query(r"""SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), '(?is)<a\s[^>]*?href="([^"]*)"', 1)) AS url FROM pages""")
def page_navigation(s, d):
    """Links of the first navigation region."""
    return _records(s, d, "navigation").select("page_id", F.explode("navigation").alias("x")).select("page_id", "x.url")


@query()
def page_main_content(s, d):
    return _records(s, d, "main_content").select("page_id", F.md5(F.col("main_content").cast("binary")).alias("digest"), F.length("main_content").alias("n"))


@query()
def page_record(s, d):
    """Every field of the pages, as counts."""
    return P.records(_typed(s, d)).select("page_id", "page_type", "content_hash", F.size("links").alias("links"), F.size("images").alias("images"), F.size("tables").alias("tables"), F.size("forms").alias("forms"), F.size("breadcrumbs").alias("breadcrumbs"), "product.product_name", F.size("documentation.sections").alias("sections"), F.size("questions").alias("questions"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '(?s)var\s+(\w+)\s*=\s*(?:\{.*?\}|\[.*?\]|"[^"]*"|''[^'']*'')\s*;', 1)) AS name FROM pages""")
def page_script_values(s, d):
    """Names of JavaScript variables with a literal value."""
    return load(s, d, "pages").select("page_id", F.explode(P.script_values(F.col("html"))).alias("x")).select("page_id", "x.name")


@query()
def page_sanitised(s, d):
    """Only the allowed tags and attributes."""

    def clean(batches):
        from quarry.functions.html import sanitise

        for b in P.slices(batches):
            yield b[["page_id"]].assign(html=[sanitise(h) for h in b["html"]])

    ship(s)
    safe = load(s, d, "pages").select("page_id", "html").mapInPandas(clean, "page_id long, html string")
    return safe.select("page_id", F.md5(F.col("html").cast("binary")).alias("digest"), F.col("html").rlike("(?i)<(script|style|nav|article|div)").alias("unsafe"))


@query()
def helper_clean_text(s, d):
    """Text of markup in compatibility form, without control characters."""

    def clean(batches):
        from quarry.functions.html import helper_clean

        for b in P.slices(batches):
            yield b[["doc_id"]].assign(text=[helper_clean(t) for t in b["text"]])

    ship(s)
    return load(s, d, "documents").select("doc_id", "text").mapInPandas(clean, "doc_id long, text string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# ---- crawls over a site made of the orders of customers: a page for each, with links


def _site(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pages, links): customers' pages on hosts by nation group, each with links to others and to files."""
    c = load(s, d, "customer").select(F.col("c_custkey").alias("k"))
    url = lambda k: F.concat(F.lit("http://site.org/p/"), k.cast("string"))
    n = load(s, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    x = c.join(F.broadcast(n)).select("k", "n", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos"))
    to = F.when(F.col("pos") == 1, F.concat(F.lit("http://other.org/p/"), F.col("k").cast("string"))).when(F.col("pos") == 2, F.concat(url(F.col("k")), F.lit(".PDF"))).otherwise(url((F.col("k") * 3 + F.col("pos") + 1) % F.col("n")))
    return c.select(url(F.col("k")).alias("url")), x.select(url(F.col("k")).alias("src"), "pos", to.alias("dst"))


@query()
def crawl_site(s, d):
    """Breadth-first from one page: one host, ten links a page, at most a hundred pages."""
    pages, links = _site(s, d)
    path = scratch(s, "crawl")
    n = iter(range(1_000_000))

    def stage(df: DataFrame) -> DataFrame:
        at = f"{path}/{next(n)}"
        df.write.parquet(at)
        return s.read.schema(df.schema).parquet(at)

    return P.crawl(pages, links, "http://site.org/p/1", 100, 10, stage)


@query("""WITH c AS (SELECT c_custkey AS k, (SELECT count(*) FROM customer) AS n FROM customer), l AS (SELECT 'http://site.org/p/' || k AS src, pos, CASE pos WHEN 1 THEN 'http://other.org/p/' || k WHEN 2 THEN 'http://site.org/p/' || k || '.PDF' ELSE 'http://site.org/p/' || ((k * 3 + pos + 1) % n) END AS dst FROM c, range(0, 12) t(pos))
SELECT src, count(*) FILTER (starts_with(dst, 'http://site.org/') AND NOT ends_with(lower(dst), '.pdf')) AS in_scope FROM l GROUP BY src""")
def crawl_scope(s, d):
    """Links on the same host, less files that a crawl skips."""
    l = _site(s, d)[1]
    return l.groupBy("src").agg(F.count_if(P.in_scope(F.col("dst"), F.col("src"))).alias("in_scope"))


@query("""WITH c AS (SELECT c_custkey AS k, (SELECT count(*) FROM customer) AS n FROM customer), l AS (SELECT 'http://site.org/p/' || k AS src, pos, CASE pos WHEN 1 THEN 'http://other.org/p/' || k WHEN 2 THEN 'http://site.org/p/' || k || '.PDF' ELSE 'http://site.org/p/' || ((k * 3 + pos + 1) % n) END AS dst FROM c, range(0, 12) t(pos)),
s(section, src) AS (VALUES ('other', 'http://site.org/p/1'), ('1', 'http://site.org/p/2'))
SELECT section, src AS url FROM s UNION SELECT section, dst FROM l JOIN s ON s.src = l.src WHERE pos < 20 AND contains(lower(dst), section)""")
def crawl_sections(s, d):
    """Known sections, and their first links that hold the section's name."""
    return P.sections(_site(s, d)[1], {"other": "http://site.org/p/1", "1": "http://site.org/p/2"})
