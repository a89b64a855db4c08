"""The structure of the graph, the vector index, mergeable sketches, variant properties and counters of a run: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import properties as P
from quarry.functions import sketches as K
from quarry.operators import graph as G
from quarry.operators.counted import Counters
from quarry.operators.tiles import triangles_of_groups
from quarry.plans.catalogue import _GEO, _NODES, load, query
from quarry.plans.processing import _CHAIN, LEAST_QUALITY, items, normalised, scored, valid
from quarry.sources import keyed_table as T
from quarry.sources import vector_index as I
from quarry.sources.fetching import fetched
from quarry.sources.staging import new_path

# ---- connected components, triangles, density


def places(s: SparkSession, d: str) -> DataFrame:
    """located_in edges of nations, suppliers and customers."""
    c = load(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("located_in").alias("rel"))
    return G.geo_edges(s, d).unionByName(c)


def partners(s: SparkSession, d: str) -> DataFrame:
    """Edges between suppliers of one part, the smaller key first.

    A part's suppliers are one row, from which each of them takes those after it as an array;
    these arrays, not pairs, go to the supplier's task, which keeps the different ones.
    """
    l = load(s, d, "lineitem").where("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")
    of = l.groupBy("l_partkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("all")).select(F.posexplode("all").alias("i", "src"), "all")
    after = of.where(F.col("i") + 1 < F.size("all")).select("src", F.slice("all", F.col("i") + 2, F.size("all")).alias("others"))
    # dealt by src alone, which serves for the distinct pairs too
    pairs = after.repartition("src").select("src", F.explode("others").alias("dst")).distinct()
    return pairs.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("partner").alias("rel"))


_PARTNERS = "l AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), e AS (SELECT DISTINCT a.l_suppkey::VARCHAR AS src, b.l_suppkey::VARCHAR AS dst FROM l a JOIN l b USING (l_partkey) WHERE a.l_suppkey < b.l_suppkey), u AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y FROM e)"


@query(f"""WITH RECURSIVE {_NODES}, {_GEO}, pl AS (SELECT src, dst FROM edges UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), b AS (SELECT src, dst FROM pl UNION SELECT dst, src FROM pl),
w AS (SELECT id AS node, id AS root FROM nodes WHERE type IN ('region', 'part') UNION SELECT dst, root FROM w JOIN b ON src = node), m AS (SELECT node, min(node) OVER (PARTITION BY root) AS component FROM w)
SELECT component, count(*) AS n FROM m GROUP BY component""")
def graph_components(s, d):
    """Sizes of the connected components of places; parts are alone."""
    return G.components(places(s, d), G.nodes(s, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PARTNERS}, t AS (SELECT a.x, a.y, b.y AS z FROM u a JOIN u b ON a.y = b.x JOIN u c ON c.x = a.x AND c.y = b.y), n AS (SELECT unnest([x, y, z]) AS id FROM t), k AS (SELECT id, count(*) AS triangles FROM n GROUP BY id), g AS (SELECT id, count(*) AS degree FROM (SELECT unnest([x, y]) AS id FROM u) GROUP BY id)
SELECT s_suppkey::VARCHAR AS id, round(CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2) ELSE 0 END, 9) AS coefficient FROM supplier LEFT JOIN g ON g.id = s_suppkey::VARCHAR LEFT JOIN k ON k.id = g.id""")
def graph_clustering(s, d):
    """The clustering coefficient of each supplier among those that supply the same parts."""
    n = load(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    supplied = load(s, d, "lineitem").where("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL").select(F.col("l_partkey").alias("group"), F.col("l_suppkey").cast("string").alias("id"))
    return G.coefficients(triangles_of_groups(supplied), n).select("id", F.round("coefficient", 9).alias("coefficient"))


@query(f"WITH {_PARTNERS} SELECT (SELECT count(*) FROM supplier) AS nodes, count(*) AS edges, 2 * count(*) / ((SELECT count(*) FROM supplier) * ((SELECT count(*) FROM supplier) - 1)) AS density FROM u")
def graph_density(s, d):
    return G.density(partners(s, d), load(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id")))


# ---- the vector index


def _anchor(s: SparkSession, d: str, i: int) -> list[float]:
    return load(s, d, "embeddings").where(F.col("vec_id") == i).first()["embedding"]


_NEAR = "SELECT e.vec_id, round(1 - list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2))), 6) AS relevance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY relevance DESC, vec_id LIMIT 10"


@query(_NEAR)
def vector_index_search(s, d):
    """The nearest vectors through an inverted file over all its cells, part of them appended later."""
    e, path = load(s, d, "embeddings"), new_path(s, "index")
    I.build(e.where("vec_id % 5 <> 0"), path, 16)
    I.append(e, path)
    return I.search(s, path, _anchor(s, d, 3))


@query("SELECT count(*) AS queries, true AS found_itself, true AS recall_over_09 FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(s, d):
    """Every fiftieth vector searched in 14 of 16 cells, against all: these vectors are noise without clusters, the hardest case (tests have clusters)."""
    e, path = load(s, d, "embeddings"), new_path(s, "index")
    I.build(e, path, 16)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    part, whole = I.search_many(q, path, 10, 14), I.search_many(q, path, 10, 16)
    hit = whole.select("query", "vec_id").join(part.select("query", "vec_id", "rank"), ["query", "vec_id"], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), (F.count_if((F.col("query") == F.col("vec_id")) & (F.col("rank") == 1)) == F.countDistinct("query")).alias("found_itself"), (F.count("rank") >= 0.9 * F.count(F.lit(1))).alias("recall_over_09"))


# ---- sketches, variant properties, counters, merges


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, true AS distinct_within, true AS median_within FROM events GROUP BY ALL")
def sketches_by_month(s, d):
    """Distinct users and medians of months, from sketches kept by day, each within its bound of the exact value."""
    e, path = load(s, d, "events"), new_path(s, "sketches")
    K.by_day(e, "ts", "user_id", "value", "event_type").write.parquet(path)
    month = F.date_format("day", "yyyy-MM").alias("month")
    m = K.merged(s.read.parquet(path), month, "event_type").select("month", "event_type", "n", K.distinct_count().alias("about"), K.quantile(0.5).alias("median"))
    e = e.withColumn("month", F.date_format("ts", "yyyy-MM")).join(m, ["month", "event_type"])
    below, upto = F.avg((F.col("value") < F.col("median")).cast("int")), F.avg((F.col("value") <= F.col("median")).cast("int"))
    exact = e.groupBy("month", "event_type", "n", "about").agg(F.countDistinct("user_id").alias("users"), below.alias("below"), upto.alias("upto"))
    # three standard errors for the count; a rank near a half for the median
    near = F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1.0), 3 * 0.0065 * F.col("users"))
    return exact.select("month", "event_type", "n", near.alias("distinct_within"), ((F.col("below") <= 0.515) & (F.col("upto") >= 0.485)).alias("median_within"))


@query("SELECT event_id, (props->>'k')::INT AS k, user_id FROM events WHERE (props->>'k')::INT >= 50")
def property_filter(s, d):
    """Events by a typed property, from properties stored as variants."""
    path = new_path(s, "variants")
    load(s, d, "events").select("event_id", "user_id", P.parsed(F.col("props")).alias("props")).write.parquet(path)
    v = s.read.parquet(path).withColumn("k", P.at("props", "$.k", "int"))
    return v.where("k >= 50").select("event_id", "k", "user_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE (props->>'k')::INT END AS k, CASE WHEN event_id % 2 = 0 THEN 'yes' END AS seen FROM events WHERE event_id % 3 = 0 OR (props->>'k')::INT = 7")
def property_update(s, d):
    """Properties added and replaced, and found by their values."""
    new = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit(', "new": true}')))
    seen = F.when(F.col("event_id") % 2 == 0, '{"seen": "yes"}')
    e = load(s, d, "events").withColumn("p", P.updated(P.updated(P.parsed(F.col("props")), P.parsed(new)), P.parsed(seen)))
    return e.where(P.holds("p", {"$.new": True}) | P.holds("p", {"$.k": 7})).select("event_id", P.at("p", "$.k", "long").alias("k"), P.at("p", "$.seen", "string").alias("seen"))


@query(f"WITH {_CHAIN} SELECT (SELECT count(*) FROM items) AS seen, (SELECT count(*) FROM valid) AS valid, (SELECT count(*) FROM scored WHERE quality_score >= {LEAST_QUALITY}) AS kept, (SELECT count(*) FROM scored WHERE term_kinds > 0) AS with_terms, (SELECT coalesce(sum(length(text)), 0)::BIGINT FROM scored WHERE quality_score >= {LEAST_QUALITY}) AS characters")
def process_counters(s, d):
    """What a run of the chain saw, accepted, enriched and stored, counted in the pass that stores."""
    c = processed(items(s, d), new_path(s, "processed"))
    return s.createDataFrame([(c["seen"], c["valid"], c["kept"], c["valid.with_terms"], c["kept.characters"] or 0)], "seen long, valid long, kept long, with_terms long, characters long")


def processed(scraped: DataFrame, path: str) -> dict[str, object]:
    """Writes what the chain keeps of ``scraped`` items; returns the run's counters."""
    c = Counters()
    t = c.watch(scraped, "seen")
    t = c.watch(scored(normalised(t.where(valid(t)))), "valid", with_terms=F.count_if(F.col("term_kinds") > 0))
    c.watch(t.where(F.col("quality_score") >= LEAST_QUALITY), "kept", characters=F.sum(F.length("main_content"))).write.parquet(path)
    return c.values()


@query("""SELECT c_custkey, CASE WHEN o.p IS NOT NULL THEN o.p ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE c_custkey % 11 <> 0
UNION ALL SELECT -1, 'new', NULL""")
def keyed_merge(s, d):
    """Upserts and deletions through a table in buckets, of which only those hit are rewritten."""
    path = new_path(s, "keyed")
    c = load(s, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    T.create(c, path, "c_custkey", 16)
    new = load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    T.merge(new.join(c.select("c_custkey"), "c_custkey", "left_semi"), path, [F.col("o_orderkey")])
    T.merge(c.where("c_custkey % 11 = 0").select("c_custkey"), path, delete=F.lit(True))
    T.merge(s.createDataFrame([(-1, "new")], "c_custkey long, c_mktsegment string"), path)
    return T.read(s, path)


@query("SELECT url, CASE WHEN page_id % 7 = 3 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 7 = 3 THEN 3 WHEN page_id % 7 = 5 THEN 2 ELSE 1 END AS attempts, CASE WHEN page_id % 7 <> 3 THEN md5(coalesce(html, '')) END AS digest FROM (SELECT url, min(page_id) AS page_id, arg_min(coalesce(html, ''), page_id) AS html FROM pages WHERE url IS NOT NULL GROUP BY url)")
def pages_fetched(s, d):
    """The pages' urls fetched host by host from a folder that stands for the web, some of them gone or only there at a second try."""
    p = load(s, d, "pages").where("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by(F.coalesce("html", F.lit("")), "page_id").alias("html"))
    path = new_path(s, "web").removeprefix("file://")
    # ordered, in row groups of about a hundred pages: a lookup reads one of them, however many pages there are
    small = {"parquet.block.size": str(1 << 16), "parquet.page.size": str(1 << 16), "parquet.block.size.row.check.min": "100", "parquet.page.size.row.check.min": "100"}
    p.select("page_id", "html", F.md5(F.col("url").cast("binary")).substr(1, 2).alias("part"), "url").repartition("part").sortWithinPartitions("part", "url").write.partitionBy("part").options(**small).parquet(path)
    tried: set[str] = set()

    def opener(url: str) -> tuple[int, str | None]:
        import hashlib

        from pyarrow import dataset

        at = f"{path}/part={hashlib.md5(url.encode()).hexdigest()[:2]}"
        found = dataset.dataset(at, format="parquet").to_table(filter=dataset.field("url") == url).to_pylist()[0]
        if found["page_id"] % 7 == 3:
            return 404, None
        if found["page_id"] % 7 == 5 and url not in tried:
            tried.add(url)
            return 429, None
        return 200, found["html"]

    f = fetched(p, opener, delay=0)
    return f.select("url", "status", "attempts", F.md5(F.col("html").cast("binary")).alias("digest"))
