"""Pages as records: one pass of a parser in Arrow batches gives every field; crawls and landed fetches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions import fixed
from quarry.functions.text import domain
from quarry.sources.staging import ship

RECORD = """page_id long, url string, content_hash string, page_type string, title string, description string, visible string, main_content string,
navigation array<struct<text:string,url:string,title:string>>, breadcrumbs array<struct<text:string,url:string>>,
metadata struct<title:string,description:string,keywords:string,author:string,published_date:string>, links array<string>,
images array<struct<src:string,alt:string,title:string,width:string,height:string>>, tables array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>,
forms array<struct<action:string,method:string,fields:array<struct<name:string,type:string,value:string,placeholder:string,required:boolean,options:array<struct<value:string,text:string>>>>>>,
product struct<product_name:string,specifications:map<string,string>,download_links:array<struct<url:string,text:string,title:string>>>,
satellite struct<satellite_name:string,launch_date:string,instruments:array<string>>, questions array<struct<question:string,answer:string>>,
documentation struct<sections:array<struct<title:string,level:int,content:string>>,code_examples:array<struct<code:string,language:string>>>"""


#: Rows of a batch that are parsed and handed on at once, so that a worker never holds the records of a whole Arrow batch.
SLICE = 64


def slices(batches: Iterator[pd.DataFrame], rows: int = SLICE) -> Iterator[pd.DataFrame]:
    """The batches in parts of at most ``rows`` rows."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def _record(url: str | None, html: str | None, wanted: frozenset[str]) -> dict[str, object]:
    """The ``wanted`` fields of a page; the others aren't computed."""
    import hashlib

    from quarry.functions import html as H

    n = H.parse(html)
    kind = H.page_type(n, url) if wanted & {"page_type", "product", "satellite", "questions", "documentation"} else None
    # the last ones take regions out of the tree, so a new one is made for them
    made = {
        "content_hash": lambda: hashlib.md5((html or "").encode()).hexdigest(),
        "page_type": lambda: kind,
        "title": lambda: H.title(n),
        "description": lambda: H.description(n),
        "visible": lambda: H.visible(n),
        "navigation": lambda: H.navigation(n),
        "breadcrumbs": lambda: H.breadcrumbs(n),
        "metadata": lambda: tuple(H.metadata(n).values()),
        "links": lambda: H.links(n, url),
        "images": lambda: H.images(n, url),
        "tables": lambda: H.tables(n),
        "forms": lambda: H.forms(n),
        "product": lambda: H.product(n) if kind == "product" else None,
        "documentation": lambda: H.documentation(n) if kind == "documentation" else None,
        "main_content": lambda: H.main_content(H.parse(html)),
        "satellite": lambda: H.satellite(H.parse(html)) if kind == "satellite" else None,
        "questions": lambda: H.faq(H.parse(html)) if kind == "faq" else None,
    }
    return {c: f() for c, f in made.items() if c in wanted}


def records(pages: DataFrame, *fields: str) -> DataFrame:
    """page_id, url and ``fields`` of ``RECORD`` (all, if none is named) for each of ``pages`` (page_id, url, html); null html is empty."""
    schema = StructType.fromDDL(RECORD)
    names = ["page_id", "url", *(f for f in schema.names[2:] if not fields or f in fields)]
    wanted = frozenset(names)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            rows = [_record(None if u is None else str(u), None if h is None else str(h), wanted) for u, h in zip(b["url"], b["html"], strict=True)]
            made = {c: pd.Series([r[c] for r in rows], dtype=object) for c in names[2:]}
            yield pd.DataFrame({"page_id": pd.Series(list(b["page_id"]), dtype=object), "url": pd.Series(list(b["url"]), dtype=object), **made})

    ship(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInPandas(parsed, StructType([schema[c] for c in names]))


def page_type(url: Column, title: Column) -> Column:
    """The type of a page by its url and else its title, as expressions."""
    out = F.lit("general")
    for where, rules in ((title, fixed.PAGE_TYPES_BY_TITLE), (url, fixed.PAGE_TYPES_BY_URL)):
        for kind, words in reversed(rules):
            hit = F.lit(False)
            for w in words:
                hit |= F.coalesce(F.lower(where).contains(w), F.lit(False))
            out = F.when(hit, kind).otherwise(out)
    return out


def category(kind: Column, text: Column) -> Column:
    out = F.lit("General")
    for name, words in reversed(fixed.CATEGORIES_BY_TEXT):
        out = F.when(F.lower(text).rlike("|".join(words)), name).otherwise(out)
    for k, name in fixed.CATEGORIES_BY_PAGE.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def in_scope(url: Column, base: Column) -> Column:
    """Same host, and no extension that a crawl skips."""
    skipped = F.lit(False)
    for x in fixed.SKIPPED_EXTENSIONS:
        skipped |= F.lower(url).endswith(x)
    return (domain(url) == domain(base)) & ~skipped


def crawl(pages: DataFrame, links: DataFrame, start: str, max_pages: int = 100, fan: int = 10, stage: Callable[[DataFrame], DataFrame] = lambda d: d.checkpoint()) -> DataFrame:
    """url, depth, rank: the pages that a breadth-first crawl from ``start`` fetches, in the order of its queue.

    ``links`` has src, pos and dst. Of a page's links in scope and not seen before, the first
    ``fan`` are queued. A level is one join with an anti-join against what was seen; levels go
    on until nothing new comes or ``max_pages`` pages are fetched, which bounds the crawl.
    """
    spark = pages.sparkSession
    level = spark.createDataFrame([(start, 0, 0)], "url string, depth int, rank long")
    seen = level
    depth = 0
    while True:
        depth += 1
        # a level is at most max_pages rows: sent to the pages and links, so that neither is dealt or ordered
        there = pages.select("url").join(F.broadcast(level.select("url")), "url", "left_semi").distinct()
        at = F.broadcast(level.join(F.broadcast(there), "url", "left_semi").select("url", "rank"))
        # staged, so that only the level's links are judged
        found = stage(links.join(at, F.col("url") == F.col("src")).select("rank", "pos", "dst")).where(in_scope(F.col("dst"), F.lit(start)))
        new = found.join(F.broadcast(seen.select(F.col("url").alias("dst"))), "dst", "left_anti").select("rank", "pos", "dst")
        from pyspark.sql import Window as W

        new = new.withColumn("k", F.row_number().over(W.partitionBy("rank").orderBy("pos"))).where(F.col("k") <= fan)
        new = new.groupBy("dst").agg(F.min(F.struct("rank", "pos")).alias("o"))
        done = seen.agg(F.max("rank")).first()[0] + 1
        if done >= max_pages:
            return seen
        # the queue's order; a level is cut to what max_pages still allows
        ordered = new.orderBy("o").limit(max_pages - done)
        level = stage(ordered.select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), (F.row_number().over(W.orderBy("o")) + (done - 1)).cast("long").alias("rank")))
        if level.isEmpty():
            return seen
        seen = stage(seen.unionByName(level))


def sections(links: DataFrame, seeds: dict[str, str], most: int = 20) -> DataFrame:
    """section, url: the seeds and, of each seed's first ``most`` links, those that hold the section's name."""
    s = links.sparkSession.createDataFrame(list(seeds.items()), "section string, src string")
    first = F.broadcast(s)
    found = links.where(F.col("pos") < most).join(first, "src").where(F.lower("dst").contains(F.col("section"))).select("section", F.col("dst").alias("url"))
    return s.select("section", F.col("src").alias("url")).unionByName(found).distinct()


def fetch(urls: DataFrame, opener: Callable[[str], tuple[int, str]], retries: int = 3, delay: float = 1.0) -> DataFrame:
    """url, status, html, attempts of each url: status 429 waits ``delay`` times 2 to the number of attempts, other failures ``delay``.

    ``opener`` gives (status, body) or raises; it must be picklable.
    """

    def got(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            rows = []
            for url in b["url"]:
                status, body, n = 0, None, 0
                while n < retries:
                    n += 1
                    try:
                        status, body = opener(url)
                    except OSError:
                        status, body = 0, None
                    if status == 200:
                        break
                    time.sleep(delay * 2 ** (n - 1) if status == 429 else delay)
                rows.append((url, status, body if status == 200 else None, n))
            yield pd.DataFrame(rows, columns=["url", "status", "html", "attempts"])

    return urls.select("url").mapInPandas(got, "url string, status int, html string, attempts int")


def script_values(html: Column) -> Column:
    """array<struct<name, value>> of the JavaScript variables that scripts set to an object, array or string."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?s)var\s+\w+\s*=\s*(?:\{.*?\}|\[.*?\]|"[^"]*"|'[^']*')\s*;"""), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"var\s+(\w+)", 1).alias("name"), F.regexp_extract(m, r"(?s)=\s*(.*?)\s*;$", 1).alias("value")))
