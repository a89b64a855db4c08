"""Queries of the engine by name, and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.fixed import SATELLITES, SKIPPED_EXTENSIONS, TERMS
from quarry.operators import graph as G
from quarry.operators import relational as R
from quarry.operators import vector as V
from quarry.operators.mutation import upsert_last
from quarry.sources.staging import shared_dir
from quarry.sources.tables import load
from quarry.streaming import windows as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_GEO = """edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'located_in' AS rel FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier)"""
_ALL = """edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'located_in' AS rel FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in' FROM customer
 UNION ALL (SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'supplies' FROM lineitem)
 UNION ALL (SELECT DISTINCT 'c' || o_custkey, 'p' || l_partkey, 'ordered' FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""
_NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'region' AS type, 1 - (r_regionkey % 10) / 20.0 AS confidence FROM region
 UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation', 1 - (n_nationkey % 10) / 20.0 FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier', 1 - (s_suppkey % 10) / 20.0 FROM supplier
 UNION ALL SELECT 'c' || c_custkey, c_name, 'customer', 1 - (c_custkey % 10) / 20.0 FROM customer UNION ALL SELECT 'p' || p_partkey, p_name, 'part', 1 - (p_partkey % 10) / 20.0 FROM part)"""
_BOTH = "both_ways AS (SELECT src, dst, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges)"
_L2 = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2)))"
_SEM = f"SELECT d.doc_id, d.text, d.source, round(1 - {_L2}, 6) AS relevance FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY relevance DESC, d.doc_id LIMIT 10"


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return load(s, d, name)


# ---- retrieval


@query(f"""WITH sem AS ({_SEM}), kw AS (SELECT doc_id, text, source FROM documents WHERE text ILIKE '%the%' ORDER BY doc_id LIMIT 10),
u AS (SELECT doc_id, text, source, round(relevance * 1.2, 6) AS score, 0 AS leg FROM sem UNION ALL SELECT doc_id, text, source, 0.8::DOUBLE, 1 FROM kw),
k AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source, '') || ':' || substr(coalesce(text, ''), 1, 100) ORDER BY leg, score DESC, doc_id) AS rn FROM u)
SELECT doc_id, score, leg, substr(text, 1, 500) AS preview FROM k WHERE rn = 1 ORDER BY score DESC, leg, doc_id LIMIT 10""")
def hybrid_search(s, d):
    return V.hybrid(_t(s, d, "documents"), _t(s, d, "embeddings"), 0, "the")


@query(f"SELECT doc_id, relevance FROM ({_SEM})")
def semantic_search(s, d):
    return V.semantic(_t(s, d, "documents"), _t(s, d, "embeddings"), 0).select("doc_id", "relevance")


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview FROM documents WHERE text ILIKE '%the%' ORDER BY doc_id LIMIT 20")
def keyword_search(s, d):
    return V.keyword(_t(s, d, "documents"), "the", 20).select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, lang, source, n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3') AND quality >= 1 AND n_chars >= 200")
def search_filters(s, d):
    f = R.SearchFilters(sources=["src1", "src2", "src3"], languages=["en", "fr"], quality_min=1, least_chars=200)
    j = _t(s, d, "documents").join(_t(s, d, "labels").withColumnRenamed("quality", "quality_score"), "doc_id", "left")
    return j.where(f.condition()).select("doc_id", "lang", "source", "n_chars")


@query("SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE vec_id <> 3 ORDER BY similarity DESC, vec_id LIMIT 5")
def similar_documents(s, d):
    return V.most_similar(_t(s, d, "embeddings"), 3)


@query("SELECT (len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS healthy, count(*) AS n FROM embeddings GROUP BY 1")
def embedding_health(s, d):
    return V.health(_t(s, d, "embeddings"), 64)


@query("SELECT event_type, round(least(1.0, 0.7 * avg(value / 1000) + 0.3 * least(count(*) / 5.0, 1.0)), 6) AS confidence FROM events GROUP BY event_type")
def confidence_score(s, d):
    return V.confidence(_t(s, d, "events").withColumn("value", F.col("value") / 1000), "event_type", "value")


_PAIRS = "round(avg(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean, round(stddev_pop(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS deviation, count(*) AS pairs FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query(f"SELECT a.label, {_PAIRS} AND a.label = b.label GROUP BY a.label UNION ALL SELECT NULL, {_PAIRS}")
def pairwise_distance_stats(s, d):
    return V.pairwise_distances(_t(s, d, "embeddings"), "label")


@query()
def kmeans_clusters(s, d):
    return V.kmeans(_t(s, d, "embeddings"))


@query()
def pca_2d(s, d):
    return V.pca(_t(s, d, "embeddings"))


# ---- records


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'F') ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 50")
def list_records(s, d):
    o = R.matching(_t(s, d, "orders"), o_orderstatus=["O", "F"], unknown=1)
    return R.page(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], 100, 50).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def get_by_id(s, d):
    return R.by_id(_t(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", 7)


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_filtered(s, d):
    return R.matching(_t(s, d, "orders"), o_orderstatus="O").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_distribution(s, d):
    return _t(s, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS recent")
def statistics_block(s, d):
    n = lambda t: _t(s, d, t).agg(F.count(F.lit(1)).alias(t))
    e = _t(s, d, "events")
    recent = e.join(F.broadcast(e.agg(F.max("ts").alias("m")))).where(F.col("ts") >= F.col("m") - F.expr("INTERVAL 24 HOURS")).agg(F.count(F.lit(1)).alias("recent"))
    return n("documents").join(n("pages")).join(n("conversations").withColumnRenamed("conversations", "messages")).join(recent)


@query("SELECT event_type AS query, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def trending_queries(s, d):
    e = _t(s, d, "events")
    r = e.join(F.broadcast(e.agg(F.max("ts").alias("m")))).where(F.col("ts") >= F.col("m") - F.expr("INTERVAL 30 DAYS"))
    return r.groupBy(F.col("event_type").alias("query")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query").limit(10)


@query("SELECT DISTINCT event_type AS suggestion FROM events WHERE lower(event_type) LIKE 'c%' ORDER BY 1 LIMIT 10")
def suggestions(s, d):
    return _t(s, d, "events").where(F.lower("event_type").startswith("c")).select(F.col("event_type").alias("suggestion")).distinct().orderBy("suggestion").limit(10)


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL")
def facets(s, d):
    t = _t(s, d, "documents")
    f = lambda c: t.groupBy(F.lit(c).alias("facet"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return f("lang").unionByName(f("source"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def having_duplicates(s, d):
    return R.repeated(_t(s, d, "documents"), "text")


@query("SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants FROM conversations GROUP BY 1")
def conversation_stats(s, d):
    return _t(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"))


@query("SELECT count(*) AS visited, count(*) FILTER (html IS NULL OR html = '') AS failed, round(count(*) FILTER (html <> '') / count(*), 6) AS success_rate FROM pages")
def crawl_stats(s, d):
    p = _t(s, d, "pages")
    bad = F.coalesce(F.col("html") == "", F.lit(True))
    return p.agg(F.count(F.lit(1)).alias("visited"), F.count_if(bad).alias("failed"), F.round(F.try_divide(F.count_if(~bad), F.count(F.lit(1))), 6).alias("success_rate"))


@query("""SELECT c_custkey, coalesce(last, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def upsert_keep_last(s, d):
    """Customers' segments replaced by their orders' priorities, of which the last by date counts."""
    c = _t(s, d, "customer").select("c_custkey", "c_mktsegment")
    new = _t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderdate", "o_orderkey")
    new = new.join(c.select("c_custkey"), "c_custkey", "left_semi")
    return upsert_last(c, new, "c_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rows_without_children(s, d):
    """Customers without orders, by an anti-join."""
    return _t(s, d, "customer").join(_t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT DISTINCT 'n' || n_nationkey AS s, 'in' AS p, 'r' || n_regionkey AS o FROM nation")
def triple_insert_distinct(s, d):
    t = _t(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("in").alias("p"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("o"))
    return t.union(t).distinct()


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def unique_violations(s, d):
    return R.repeated(_t(s, d, "part"), "p_name")


@query("SELECT doc_id FROM documents WHERE text IS NULL OR lang IS NULL")
def not_null_violations(s, d):
    return _t(s, d, "documents").where("text IS NULL OR lang IS NULL").select("doc_id")


@query("SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def last_n_messages(s, d):
    return R.last_n(_t(s, d, "conversations"), "conv_id", "turn", 6).select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("SELECT conv_id, md5(string_agg('**' || role || '**: ' || text, chr(10) ORDER BY turn)) AS markdown FROM conversations GROUP BY conv_id")
def export_markdown(s, d):
    line = F.struct("turn", F.concat(F.lit("**"), F.col("role"), F.lit("**: "), F.col("text")).alias("x"))
    return _t(s, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["x"]), "\n").cast("binary")).alias("markdown"))


# ---- graph


@query(f"WITH {_NODES} SELECT id, name, type FROM nodes WHERE type = 'supplier' AND contains(name, '1') AND confidence >= 0.8")
def find_entities(s, d):
    return G.nodes(s, d).where((F.col("type") == "supplier") & F.col("name").contains("1") & (F.col("confidence") >= 0.8)).select("id", "name", "type")


@query(f"WITH {_NODES} SELECT id, name FROM nodes WHERE contains(lower(name), 'an') AND type IN ('nation', 'region')")
def find_entities_ci(s, d):
    return G.nodes(s, d).where(F.lower("name").contains("an") & F.col("type").isin("nation", "region")).select("id", "name")


@query(f"WITH {_NODES}, {_ALL} SELECT s.name AS source, rel, t.name AS target FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.type = 'supplier' AND rel = 'located_in'")
def find_relations(s, d):
    n, e = G.nodes(s, d), G.edges(s, d).where("rel = 'located_in'")
    a, b = (n.select(F.col("id").alias(k), F.col("name").alias(v), F.col("type").alias(f"{v}_type")) for k, v in (("src", "source"), ("dst", "target")))
    return e.join(a.where("source_type = 'supplier'"), "src").join(b, "dst").select("source", "rel", "target")


@query(f"WITH {_NODES}, {_ALL}, {_BOTH} SELECT id, name, type, rel FROM both_ways JOIN nodes ON id = dst WHERE src = 'n3'")
def find_neighbors_both(s, d):
    return G.neighbours(G.edges(s, d), G.nodes(s, d), "n3")


@query(f"WITH {_NODES}, {_ALL} SELECT id, name, type, rel FROM edges JOIN nodes ON id = src WHERE dst = 'n3'")
def find_neighbors_in(s, d):
    return G.neighbours(G.edges(s, d), G.nodes(s, d), "n3", "in")


@query(f"WITH {_NODES}, {_ALL} SELECT id, name, type, rel FROM edges JOIN nodes ON id = dst WHERE src = 's1'")
def find_neighbors_out(s, d):
    return G.neighbours(G.edges(s, d), G.nodes(s, d), "s1", "out")


@query("SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def domain_2hop(s, d):
    n = _t(s, d, "nation").join(_t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _t(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name", "r_name")


@query("SELECT p_name, s_name, n_name, r_name FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def data_chain_3hop(s, d):
    """Every chain part, supplier, nation, region."""
    l = _t(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    c = l.join(_t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(_t(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    n = _t(s, d, "nation").join(_t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("p_name", "s_name", "n_name", "r_name")


@query("SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def optional_match(s, d):
    return _t(s, d, "nation").join(_t(s, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


def _walk(depth: int) -> str:
    return f"""{_GEO}, {_BOTH}, w AS (SELECT 's1' AS node, ['s1'] AS path, 0 AS depth UNION ALL SELECT dst, list_append(path, dst), depth + 1 FROM w JOIN both_ways ON src = node WHERE depth < {depth} AND NOT list_contains(path, dst))"""


@query(f"WITH RECURSIVE {_walk(5)} SELECT array_to_string(path, '>') AS path, depth AS length FROM w WHERE node = 's2' AND depth > 0 ORDER BY length, path LIMIT 10")
def find_paths(s, d):
    return G.paths(G.geo_edges(s, d), "s1", "s2")


@query(f"WITH RECURSIVE {_walk(3)} SELECT node, min(depth) AS distance FROM w GROUP BY node")
def traversal_min_depth(s, d):
    return G.within(G.geo_edges(s, d), "s1", 3)


@query(f"WITH RECURSIVE {_walk(2)}, i AS (SELECT DISTINCT node FROM w) SELECT src, dst, rel FROM edges WHERE src IN (SELECT node FROM i) AND dst IN (SELECT node FROM i)")
def ego_subgraph(s, d):
    e = G.geo_edges(s, d)
    return G.induced(e, G.within(e, "s1", 2).select("node"))


@query(f"WITH {_GEO} SELECT src, dst, rel FROM edges WHERE src LIKE 'n%' AND dst LIKE 'r%'")
def typed_subgraph(s, d):
    n = G.nodes(s, d).where("type IN ('nation', 'region')").select(F.col("id").alias("node"))
    return G.induced(G.geo_edges(s, d), n)


@query(f"""WITH {_NODES}, {_ALL}, b AS (SELECT DISTINCT src, dst, rel FROM (SELECT src, dst, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges)),
deg AS (SELECT src AS id, count(DISTINCT dst) AS deg FROM b GROUP BY 1), sh AS (SELECT b.src AS id, count(DISTINCT b.dst) AS shared FROM b JOIN b m ON m.src = 's1' AND m.dst = b.dst AND m.rel = b.rel WHERE b.src <> 's1' GROUP BY 1)
SELECT sh.id, shared, shared / (deg + (SELECT deg FROM deg WHERE id = 's1') - shared) AS similarity FROM sh JOIN deg ON deg.id = sh.id JOIN nodes ON nodes.id = sh.id WHERE type = 'supplier'""")
def similar_jaccard(s, d):
    # s1 is a supplier, and so are the nodes it is compared with
    return G.similar_by_neighbours(G.edges(s, d, "supplier"), G.nodes(s, d), "s1")


@query(f"WITH {_NODES} SELECT id, 1.0::DOUBLE AS similarity FROM nodes WHERE type = 'supplier' AND id <> 's1' ORDER BY id LIMIT 10")
def similar_property(s, d):
    return G.nodes(s, d).where("type = 'supplier' AND id <> 's1'").select("id", F.lit(1.0).alias("similarity")).orderBy("id").limit(10)


@query(f"WITH {_GEO} SELECT DISTINCT a.src AS s, 'located_in' AS p, b.dst AS o FROM edges a JOIN edges b ON a.dst = b.src WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.src = a.src AND x.dst = b.dst)")
def transitive_inference(s, d):
    e = G.geo_edges(s, d)
    two = e.select(F.col("src").alias("s"), F.col("dst").alias("m")).join(e.select(F.col("src").alias("m"), F.col("dst").alias("o")), "m").select("s", F.lit("located_in").alias("p"), "o").distinct()
    return two.join(e, (F.col("s") == F.col("src")) & (F.col("o") == F.col("dst")), "left_anti")


@query(f"WITH {_GEO} SELECT dst AS s, 'contains' AS p, src AS o FROM edges")
def inverse_relation(s, d):
    return G.geo_edges(s, d).select(F.col("dst").alias("s"), F.lit("contains").alias("p"), F.col("src").alias("o"))


@query(f"WITH {_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type ORDER BY n DESC, type LIMIT 20")
def entity_count_by_type(s, d):
    return G.nodes(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(20)


@query(f"WITH {_ALL} SELECT rel, count(*) AS n FROM edges GROUP BY rel")
def relation_count_by_type(s, d):
    return G.edges(s, d).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NODES}, {_ALL}, {_BOTH} SELECT id, count(src) AS degree FROM nodes LEFT JOIN both_ways ON src = id GROUP BY id")
def degree(s, d):
    return G.degrees(G.edges(s, d), G.nodes(s, d))


@query(f"WITH {_NODES} SELECT type, round(avg(confidence), 6) AS confidence FROM nodes GROUP BY type")
def avg_confidence(s, d):
    return G.nodes(s, d).groupBy("type").agg(F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"WITH {_NODES} SELECT coalesce(type, 'all') AS type, count(*) AS n FROM nodes GROUP BY ROLLUP (type)")
def graph_rollup(s, d):
    return G.nodes(s, d).rollup("type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("type", F.lit("all")).alias("type"), "n")


@query(f"WITH {_NODES}, {_ALL} SELECT id, name FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges)")
def orphans(s, d):
    return G.orphans(G.an_edge_each(s, d), G.nodes(s, d)).select("id", "name")


@query(f"""WITH {_NODES}, {_ALL}, o AS (SELECT count(*) AS orphans FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges)),
r AS (SELECT coalesce(sum(c), 0)::BIGINT AS repeated FROM (SELECT count(*) AS c FROM nodes GROUP BY name HAVING count(*) > 1)), t AS (SELECT count(*) AS total FROM nodes)
SELECT total, orphans, repeated, greatest(0.0, 1 - (orphans + repeated) / greatest(total, 1)) AS score FROM t, o, r""")
def consistency_report(s, d):
    return G.consistency(G.an_edge_each(s, d), G.nodes(s, d))


@query("SELECT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 2) AS answer")
def ask_exists(s, d):
    return _t(s, d, "nation").where("n_regionkey = 2").limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


# ---- text

_SQL_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[^\p{L}\p{N}_\s.,!?;:()\-]', ' ', 'g'), '\s+', ' ', 'g'), '\s+([.,!?;:])', '\1', 'g'))"


@query(f"SELECT doc_id, md5({_SQL_CLEAN}) AS cleaned FROM documents")
def text_clean(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(X.clean(F.col("text")).cast("binary")).alias("cleaned"))


def _masked(c: str) -> str:
    for p in X.MASK_STEPS:
        c = f"regexp_replace({c}, '{p}', '[MASKED]', 'g')"
    return c


@query(f"SELECT doc_id, md5({_masked('text')}) AS masked FROM documents")
def text_mask_pii(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(X.mask(F.col("text")).cast("binary")).alias("masked"))


def _boiler(c: str) -> str:
    c = rf"regexp_replace({c}, '\s+', ' ', 'g')"
    for p in X.BOILERPLATE:
        c = f"regexp_replace({c}, '{p}', '', 'gi')"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_boiler('text')}) AS stripped FROM documents")
def text_boilerplate(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(X.strip_boilerplate(F.col("text")).cast("binary")).alias("stripped"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM documents")
def token_count(s, d):
    return _t(s, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("n"))


_TOK = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT doc_id, len(list_filter({_TOK}, lambda w: list_contains({list(X.ENGLISH)!r}, w))) AS en, len(list_filter({_TOK}, lambda w: list_contains({list(X.HINDI)!r}, w))) AS hi FROM documents)
SELECT doc_id, CASE WHEN en > hi THEN 'en' WHEN hi > 0 THEN 'hi' ELSE 'en' END AS language FROM t""")
def language_detect(s, d):
    return _t(s, d, "documents").select("doc_id", X.language(F.col("text")).alias("language"))


_KEYS = f"list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains({list(X.STOP_WORDS)!r}, w))))"


@query(f"SELECT doc_id, md5(array_to_string({_KEYS}, ' ')) AS keywords FROM documents")
def keywords_set(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(F.array_join(X.keyword_set(F.col("text")), " ").cast("binary")).alias("keywords"))


@query(f"WITH k AS (SELECT doc_id, {_KEYS} AS k FROM documents) SELECT a.doc_id, round(len(list_intersect(a.k, b.k)) / greatest(len(list_distinct(list_concat(a.k, b.k))), 1), 6) AS jaccard FROM k a JOIN k b ON b.doc_id = a.doc_id + 1")
def text_jaccard(s, d):
    k = _t(s, d, "documents").select("doc_id", X.keyword_set(F.col("text")).alias("k"))
    n = k.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("k2"))
    return k.join(n, "doc_id").select("doc_id", F.round(X.jaccard(F.col("k"), F.col("k2")), 6).alias("jaccard"))


@query(f"""WITH t AS (SELECT doc_id, unnest({_TOK}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t WHERE length(w) >= 3 GROUP BY ALL)
SELECT doc_id, w, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS rn FROM c) WHERE rn <= 5""")
def text_keywords_topk(s, d):
    c = _t(s, d, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("w")).where(F.length("w") >= 3).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("doc_id").orderBy(F.desc("n"), "w")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query(f"SELECT doc_id, round(len(list_distinct({_TOK})) / greatest(len({_TOK}), 1), 6) AS diversity FROM documents")
def lexical_quality(s, d):
    t = X.tokens(F.col("text"))
    return _t(s, d, "documents").select("doc_id", F.round(F.size(F.array_distinct(t)) / F.greatest(F.size(t), F.lit(1)), 6).alias("diversity"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, i // 100 AS chunk, md5(array_to_string(w[i + 1:i + 100], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS i FROM w)""")
def chunks_words(s, d):
    return _t(s, d, "documents").select("doc_id", F.posexplode(X.word_chunks(F.col("text"), 100)).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("long"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query("SELECT doc_id, i // 800 AS chunk, md5(substr(text, i + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS i FROM documents)")
def chunks_stride(s, d):
    return _t(s, d, "documents").select("doc_id", F.posexplode(X.stride_chunks(F.col("text"))).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("long"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query("""SELECT p_partkey, md5(p_name) AS md5, sha256(p_name) AS sha256, CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 9) || '...' ELSE p_name END AS short,
trim(substr(regexp_replace(regexp_replace(trim(lower(p_name)), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), 1, 50), '-') AS slug, strftime(DATE '2024-01-31', '%Y-%m-%d') AS day FROM part""".replace("\\\\", "\\"))
def scalar_misc(s, d):
    n = F.col("p_name")
    return _t(s, d, "part").select("p_partkey", X.hashed(n).alias("md5"), X.hashed(n, "sha256").alias("sha256"), X.truncate(n, 12).alias("short"), X.slug(n).alias("slug"), F.date_format(F.lit("2024-01-31").cast("date"), "yyyy-MM-dd").alias("day"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN length(trim(text)) < 50 THEN 'too short' END, CASE WHEN length(text) > 10000 THEN 'too long' END, CASE WHEN contains(text, '<') THEN 'markup' END], lambda x: x IS NOT NULL), ';') AS errors FROM documents")
def validate_queries(s, d):
    t = F.col("text")
    return _t(s, d, "documents").select("doc_id", X.problems((F.length(F.trim(t)) < 50, "too short"), (F.length(t) > 10000, "too long"), (t.contains("<"), "markup")).alias("errors"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE text IS NOT NULL AND length(text) BETWEEN 50 AND 100000")
def doc_validate(s, d):
    return _t(s, d, "documents").where(F.length("text").between(50, 100000)).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def doc_dedup(s, d):
    t = _t(s, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return t.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


# ---- pages


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_title(s, d):
    return _t(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(s, d):
    return _t(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain FROM pages")
def url_domain(s, d):
    return _t(s, d, "pages").select("page_id", X.domain(F.col("url")).alias("domain"))


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)
SELECT page_id, CASE WHEN ends_with(u, '/') AND length(u) - length(replace(u, '/', '')) > 2 THEN regexp_replace(u, '/+$', '') ELSE u END AS url FROM u""")
def url_normalise(s, d):
    return _t(s, d, "pages").select("page_id", X.strip_fragment(F.col("url")).alias("url"))


@query("SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'german' WHEN contains(url, '/fr/') THEN 'french' WHEN contains(url, '?') THEN 'query' ELSE 'general' END AS part FROM pages")
def url_language(s, d):
    """The part of the site that a url of these tables names."""
    u = F.col("url")
    return _t(s, d, "pages").select("page_id", F.when(u.contains("/de/"), "german").when(u.contains("/fr/"), "french").when(u.contains("?"), "query").otherwise("general").alias("part"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def page_text(s, d):
    h = X.chain(F.col("html"), ((r"<(script|style)[^>]*>[^<]*</(script|style)>", " "), (r"<[^>]*>", " "), (r"\s+", " ")))
    return _t(s, d, "pages").select("page_id", F.md5(F.trim(h).cast("binary")).alias("digest"))


# ---- windows and state


@query("""WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rank FROM events) SELECT event_id, rank, rank <= 2 AS allowed FROM r""")
def rate_limit_verdict(s, d):
    return S.rate_limit(_t(s, d, "events"), "user_id", "ts", "event_id", 2).select("event_id", "rank", "allowed")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL AND b <> event_type")
def change_detection(s, d):
    return S.changes(_t(s, d, "events"), "user_id", "event_type", "ts", "event_id").select("event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) WHERE rn = 1")
def ttl_latest(s, d):
    e = _t(s, d, "events")
    live = e.join(F.broadcast(e.agg(F.max("ts").alias("m")))).where(F.col("ts") >= F.col("m") - F.expr("INTERVAL 7 DAYS"))
    return R.first_by(live, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def counter_by_key(s, d):
    return _t(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(s, d):
    return S.tumbling(_t(s, d, "events"), "ts", "1 hour", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start, count(*) AS n FROM events, range(0, 2) t(k) GROUP BY ALL")
def sliding_counts(s, d):
    return S.sliding(_t(s, d, "events"), "ts", "2 hours", "1 hour")


@query("""WITH a AS (SELECT *, coalesce((epoch(ts)::BIGINT - epoch(lag(ts) OVER w)::BIGINT >= 86400)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM a) SELECT user_id, session, count(*) AS n, min(ts) AS start FROM b GROUP BY ALL""")
def session_counts(s, d):
    return S.sessions(_t(s, d, "events"), "ts", 86400, "user_id")


# ---- text records: terms, satellites, sentences, questions, entities

_SQL_TERMS = ", ".join(f"('{c}', '{w}')" for c, ws in TERMS.items() for w in ws)


@query(f"SELECT doc_id, category, term FROM documents, (VALUES {_SQL_TERMS}) g(category, term) WHERE contains(lower(text), term)")
def technical_terms(s, d):
    hit = lambda t, c, w: F.when(t.contains(w), F.struct(F.lit(c).alias("category"), F.lit(w).alias("term")))
    # lower-cased once a text, not once a term
    found = X.bound(F.lower("text"), lambda t: F.filter(F.array(*(hit(t, c, w) for c, ws in TERMS.items() for w in ws)), lambda x: x.isNotNull()))
    return _t(s, d, "documents").select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.category", "x.term")


@query(f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{'|'.join(SATELLITES)}')) AS name FROM documents")
def satellite_names(s, d):
    names = F.regexp_extract_all(F.lower("text"), F.lit("|".join(SATELLITES)), F.lit(0))
    return _t(s, d, "documents").select("doc_id", F.explode(names).alias("name"))


_SENT = r"list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def _sentences() -> F.Column:
    marked = F.regexp_replace("text", r"([.!?])[ \t\r\n]+", "$1\x01")
    return F.filter(F.split(marked, "\x01"), lambda x: x != "")


@query(f"WITH t AS (SELECT doc_id, {_SENT} AS l FROM documents) SELECT doc_id, (i - 1) AS pos, md5(l[i]) AS digest FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM t)")
def sentences(s, d):
    x = _t(s, d, "documents").select("doc_id", F.posexplode(_sentences()).alias("pos", "sentence"))
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("sentence").cast("binary")).alias("digest"))


@query(f"WITH t AS (SELECT doc_id, text, {_SENT} AS l FROM documents) SELECT doc_id, md5(CASE WHEN len(l) <= 3 THEN text ELSE substr(l[1] || ' ' || l[-1], 1, 150) END) AS digest FROM t")
def extractive_summary(s, d):
    l = _sentences()
    short = F.substring(F.concat_ws(" ", F.element_at(l, 1), F.element_at(l, -1)), 1, 150)
    return _t(s, d, "documents").select("doc_id", F.md5(F.when(F.size(l) <= 3, F.col("text")).otherwise(short).cast("binary")).alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, len({_SENT}) AS n_sentences, len(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '')) AS n_words, len(regexp_extract_all(lower(text), '[aeiouy]+')) AS n_syllables FROM documents)
SELECT doc_id, n_sentences, n_words, n_syllables, round(206.835::DOUBLE - 1.015::DOUBLE * n_words / greatest(n_sentences, 1) - 84.6::DOUBLE * n_syllables / greatest(n_words, 1), 4) AS flesch FROM t""")
def readability(s, d):
    words = F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != ""))
    t = _t(s, d, "documents").select("doc_id", F.size(_sentences()).cast("long").alias("n_sentences"), words.cast("long").alias("n_words"), F.regexp_count("text", F.lit("[aeiouyAEIOUY]+")).cast("long").alias("n_syllables"))
    flesch = F.lit(206.835) - 1.015 * F.col("n_words") / F.greatest("n_sentences", F.lit(1)) - 84.6 * F.col("n_syllables") / F.greatest("n_words", F.lit(1))
    return t.withColumn("flesch", F.round(flesch, 4))


def qa_pairs(s, d):
    """Turns of a user with the assistant's next turn, as question and answer."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = _t(s, d, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("question"), F.md5(F.col("answer").cast("binary")).alias("answer"))


query("""SELECT conv_id, turn, md5(text) AS question, md5(answer) AS answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")(qa_pairs)


_PROPS = """props AS (SELECT 's' || s_suppkey AS s, 'nation' AS p, s_nationkey::VARCHAR AS o FROM supplier UNION ALL SELECT 's' || s_suppkey, 'band', CAST(floor(s_acctbal / 1000) AS BIGINT)::VARCHAR FROM supplier)"""


def _props(s: SparkSession, d: str) -> DataFrame:
    t = _t(s, d, "supplier").withColumn("s", F.concat(F.lit("s"), F.col("s_suppkey")))
    both = F.array(F.struct(F.lit("nation").alias("p"), F.col("s_nationkey").cast("string").alias("o")), F.struct(F.lit("band").alias("p"), F.floor(F.col("s_acctbal") / 1000).cast("string").alias("o")))
    return t.select("s", F.explode(both).alias("x")).select("s", "x.p", "x.o")


@query(f"WITH {_PROPS} SELECT b.s AS id, count(DISTINCT a.p) / 10.0::DOUBLE AS similarity FROM props a JOIN props b ON a.p = b.p AND a.o = b.o WHERE a.s = 's1' AND b.s <> 's1' GROUP BY b.s")
def similar_shared_properties(s, d):
    p = _props(s, d)
    own = p.where("s = 's1'").select("p", "o")
    return p.where("s <> 's1'").join(own, ["p", "o"]).groupBy(F.col("s").alias("id")).agg((F.countDistinct("p") / 10.0).alias("similarity"))


# The super type of each node type of the tables.
SUPER_TYPES = {"region": "spatial_entity", "nation": "spatial_entity", "supplier": "organization", "customer": "organization", "part": "physical_object"}


@query(f"WITH {_NODES} SELECT id, super FROM nodes JOIN (VALUES {', '.join(str(x) for x in SUPER_TYPES.items())}) h(type, super) USING (type)")
def subsumption(s, d):
    h = s.createDataFrame(list(SUPER_TYPES.items()), "type string, super string")
    return G.nodes(s, d).join(F.broadcast(h), "type").select("id", "super")


def _mentions(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, start, name, kind) of each capitalised word."""
    words = F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{3,}|[^A-Z]+|[A-Z]"), F.lit(0))
    return _t(s, d, "documents").select("doc_id", F.posexplode(words).alias("pos", "name")).where(F.col("name").rlike("^[A-Z][a-z]{3,}$"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}|[^A-Z]+|[A-Z]')) AS name FROM documents)
SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS n_docs, round(least(1.0, 0.8 + CASE WHEN count(*) > 1 THEN least(0.1 * count(*), 0.2) ELSE 0 END), 4)::DOUBLE AS confidence FROM m WHERE regexp_matches(name, '^[A-Z][a-z]{3,}$') GROUP BY name""")
def entity_candidates(s, d):
    n = F.count(F.lit(1))
    conf = F.least(F.lit(1.0), F.lit(0.8) + F.when(n > 1, F.least(n * 0.1, F.lit(0.2))).otherwise(0.0))
    return _mentions(s, d).groupBy("name").agg(n.alias("mentions"), F.countDistinct("doc_id").alias("n_docs"), F.round(conf, 4).alias("confidence"))


#: Mentions of a text are taken together if one starts at most this many characters after the other's end.
NEAR = 200


@query(rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[A-Z][a-z]{{3,}}|[^A-Z]+|[A-Z]') AS l FROM documents),
p AS (SELECT r, doc_id, l, list_transform(l, lambda x: length(x)) AS n FROM t), x AS (SELECT r, doc_id, i, l[i] AS name FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)),
s AS (SELECT *, sum(length(name)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS stop FROM x), m AS (SELECT r, doc_id, i, name, stop, stop - length(name) AS start, (stop // {NEAR}) AS bin FROM s WHERE regexp_matches(name, '^[A-Z][a-z]{{3,}}$'))
SELECT a.name AS source, b.name AS target, count(*) AS n, count(DISTINCT a.doc_id) AS n_docs FROM m a JOIN m b ON a.r = b.r AND b.i > a.i AND b.start - a.stop <= {NEAR} AND a.name <> b.name GROUP BY ALL""")
def cooccurrence(s, d):
    """A range join by bins: a later mention starts in the bin of ``NEAR`` characters of the earlier one's end, or the next."""
    name = "[A-Z][a-z]{3,}"
    t = _t(s, d, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = F.arrays_zip(F.transform(F.split("text", name, -1), F.length).alias("gap"), F.regexp_extract_all("text", F.lit(name), F.lit(0)).alias("name"))
    m = t.select("doc_id", "row", F.posexplode(found).alias("pos", "x")).select("doc_id", "row", "pos", "x.gap", "x.name").where("name IS NOT NULL")
    # offsets in code points: all gaps and names so far
    m = m.withColumn("end", F.sum(F.col("gap") + F.length("name")).over(W.partitionBy("row").orderBy("pos")))
    m = m.select("doc_id", "row", "pos", "name", "end", (F.col("end") - F.length("name")).alias("start"))
    bin_of = F.floor(F.col("end") / NEAR)
    first = m.select("doc_id", "row", "pos", F.col("name").alias("source"), "end", F.explode(F.array(bin_of, bin_of + 1)).alias("bin"))
    later = m.select("row", F.col("pos").alias("at"), F.col("name").alias("target"), "start", F.floor(F.col("start") / NEAR).alias("bin"))
    near = first.join(later, ["row", "bin"]).where((F.col("at") > F.col("pos")) & (F.col("start") - F.col("end") <= NEAR) & (F.col("source") != F.col("target")))
    return near.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


_HREF = """SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages"""


def _hrefs(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "pages").select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst")).distinct()


_RESOLVED = f"""h AS ({_HREF}), l AS (SELECT src, CASE WHEN regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN dst WHEN starts_with(dst, '//') THEN regexp_extract(src, '^[^:]*:') || dst WHEN starts_with(dst, '/') THEN regexp_extract(src, '^[^:]*://[^/?#]*') || dst WHEN starts_with(dst, '#') THEN regexp_replace(src, '#.*$', '') || dst ELSE regexp_extract(src, '^[^?#]*/') || dst END AS dst FROM h WHERE src IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_RESOLVED}, w(url, depth) AS (SELECT min(url), 0 FROM pages UNION SELECT dst, depth + 1 FROM w JOIN l ON src = url WHERE depth < 50)
SELECT url, min(depth)::BIGINT AS depth FROM w GROUP BY url""")
def crawl_reach(s, d):
    """Breadth-first over links, resolved against their page's url, from the first url until no level has a new one."""
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(shared_dir(s))

    def resolved(batches):
        from urllib.parse import urljoin

        def join(src, dst):
            try:
                return urljoin(src, dst)
            except ValueError:  # no url
                return dst

        for b in batches:
            yield b.assign(dst=[join(*x) for x in zip(b["src"], b["dst"], strict=True)])

    links = _hrefs(s, d).where("src IS NOT NULL").mapInPandas(resolved, "src string, dst string").distinct().checkpoint()
    seen = level = _t(s, d, "pages").agg(F.min("url").alias("url")).withColumn("depth", F.lit(0).cast("long")).checkpoint()
    depth = 0
    while not level.isEmpty():
        depth += 1
        level = level.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        level = level.withColumn("depth", F.lit(depth).cast("long")).checkpoint()
        seen = seen.union(level)
        if depth % 8 == 0:
            seen = seen.checkpoint()
    return seen


#: Extensions a crawl skips.
SKIPPED = tuple(x[1:] for x in SKIPPED_EXTENSIONS)


@query(f"WITH l AS ({_HREF}) SELECT DISTINCT dst AS url FROM l WHERE NOT EXISTS (SELECT 1 FROM pages WHERE url = dst) AND NOT regexp_matches(lower(dst), '[.]({'|'.join(SKIPPED)})$')")
def crawl_frontier(s, d):
    links = _hrefs(s, d).where(~F.lower("dst").rlike(f"[.]({'|'.join(SKIPPED)})$"))
    return links.join(_t(s, d, "pages").select(F.col("url").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("url")).distinct()


@query(r"""SELECT page_id, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title_length, len(regexp_extract_all(html, '<h[1-6]')) AS n_headings, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs,
len(regexp_extract_all(html, '<img[ >]')) AS n_images, len(regexp_extract_all(html, '<table[ >]')) AS n_tables, len(regexp_extract_all(html, '<form[ >]')) AS n_forms, len(regexp_extract_all(html, '<li[ >]')) AS n_items FROM pages""")
def page_structure(s, d):
    n = {"n_headings": "<h[1-6]", "n_paragraphs": "<p[ >]", "n_images": "<img[ >]", "n_tables": "<table[ >]", "n_forms": "<form[ >]", "n_items": "<li[ >]"}
    title = F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).cast("long")
    return _t(s, d, "pages").select("page_id", title.alias("title_length"), *(F.regexp_count("html", F.lit(p)).cast("long").alias(c) for c, p in n.items()))


@query(r"""SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading, regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS description,
regexp_extract(html, '<meta name="keywords" content="([^"]*)"', 1) AS keywords, regexp_extract(html, '<meta name="author" content="([^"]*)"', 1) AS author FROM pages""")
def page_metadata(s, d):
    meta = (F.regexp_extract("html", f'<meta name="{k}" content="([^"]*)"', 1).alias(k) for k in ("description", "keywords", "author"))
    return _t(s, d, "pages").select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("heading"), *meta)
