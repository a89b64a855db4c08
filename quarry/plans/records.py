"""Records, mutations, listings, exports and statistics: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import graph as G
from quarry.operators import mutation as M
from quarry.operators import relational as R
from quarry.plans.catalogue import _ALL, _BOTH, _NODES, load, query
from quarry.sources import tables as S
from quarry.sources.staging import new_path as scratch

_n = lambda: F.count(F.lit(1))
_id = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))


# ---- sources and sinks


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def json_round_trip(s, d):
    """Written as JSON and read back with a stated schema."""
    o = load(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = scratch(s, "json")
    S.write_json(o, path)
    return s.read.schema(o.schema).json(path)


@query("SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal >= 1000 GROUP BY n_name")
def sql_passthrough(s, d):
    """Parameterised SQL over tables passed by name."""
    text = "SELECT n_name, count(*) AS n FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey WHERE s_acctbal >= :least GROUP BY n_name"
    return s.sql(text, args={"least": 1000}, nation=load(s, d, "nation"), supplier=load(s, d, "supplier"))


def triples(s: SparkSession, d: str) -> DataFrame:
    """s, p, o of suppliers: their nation, name and balance band."""
    t = load(s, d, "supplier").withColumn("s", _id("s", "s_suppkey"))
    po = lambda p, o: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"))
    return t.select("s", F.explode(F.array(po("in", _id("n", "s_nationkey")), po("name", F.col("s_name")), po("band", F.floor(F.col("s_acctbal") / 1000)))).alias("x")).select("s", "x.p", "x.o")


_TRIPLES = "triples AS (SELECT 's' || s_suppkey AS s, 'in' AS p, 'n' || s_nationkey AS o FROM supplier UNION ALL SELECT 's' || s_suppkey, 'name', s_name FROM supplier UNION ALL SELECT 's' || s_suppkey, 'band', CAST(floor(s_acctbal / 1000) AS BIGINT)::VARCHAR FROM supplier)"


@query(f"WITH {_TRIPLES} SELECT a.s AS subject, b.o AS name, c.o AS band FROM triples a JOIN triples b ON a.s = b.s AND b.p = 'name' LEFT JOIN triples c ON c.s = a.s AND c.p = 'band' WHERE a.p = 'in' AND a.o IN ('n1', 'n2', 'n3')")
def triples_select(s, d):
    """A SELECT over the triples, with an optional pattern."""
    text = "SELECT a.s AS subject, b.o AS name, c.o AS band FROM {t} a JOIN {t} b ON a.s = b.s AND b.p = 'name' LEFT JOIN {t} c ON c.s = a.s AND c.p = 'band' WHERE a.p = 'in' AND a.o IN ('n1', 'n2', 'n3')"
    return s.sql(text, t=triples(s, d))


@query(f"WITH {_TRIPLES} SELECT o AS s, 'hosts' AS p, s AS o FROM triples WHERE p = 'in' UNION ALL SELECT s, 'type', 'supplier' FROM triples WHERE p = 'in'")
def triples_construct(s, d):
    """CONSTRUCT: two new triples of each match."""
    t = triples(s, d).where("p = 'in'")
    made = F.array(F.struct(F.col("o").alias("s"), F.lit("hosts").alias("p"), F.col("s").alias("o")), F.struct(F.col("s").alias("s"), F.lit("type").alias("p"), F.lit("supplier").alias("o")))
    return t.select(F.explode(made).alias("x")).select("x.*")


# ---- mutations


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 100000000, 'copy of ' || c_name FROM customer WHERE c_custkey % 10 = 0")
def insert_new(s, d):
    c = load(s, d, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 100000000).alias("c_custkey"), F.concat(F.lit("copy of "), F.col("c_name")).alias("c_name"))
    return M.insert(c, new.unionByName(c.where("c_custkey % 7 = 0")).unionByName(new), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 = 0")
def insert_rejected(s, d):
    c = load(s, d, "customer").select("c_custkey", "c_name")
    return M.rejected(c, c.where("c_custkey % 7 = 0").unionByName(c.limit(5).select((F.col("c_custkey") + 100000000).alias("c_custkey"), "c_name")), "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey = 7 THEN TIMESTAMP '2024-02-01 00:00:00' END AS updated_at FROM orders")
def update_by_id(s, d):
    o = load(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return M.update(o, "o_orderkey", 7, F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"), o_orderstatus="X")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_id(s, d):
    gone = load(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return M.delete(load(s, d, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query("SELECT k AS c_custkey, k IN (SELECT c_custkey FROM customer) AS deleted FROM (SELECT DISTINCT o_custkey * 3 AS k FROM orders)")
def delete_flags(s, d):
    return M.deletions(load(s, d, "customer"), load(s, d, "orders").select((F.col("o_custkey") * 3).alias("c_custkey")), "c_custkey")


@query("""WITH old AS (SELECT c_custkey AS id, 'segment' AS k, c_mktsegment AS v FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer),
new AS (SELECT o_custkey AS id, 'last_order' AS k, o_orderkey::VARCHAR AS v, o_orderkey AS ord FROM orders UNION ALL SELECT o_custkey, 'segment', o_orderpriority, o_orderkey FROM orders),
last AS (SELECT id, k, arg_max(v, ord) AS v FROM new GROUP BY ALL),
m AS (SELECT coalesce(o.id, l.id) AS id, coalesce(o.k, l.k) AS k, coalesce(l.v, o.v) AS v FROM old o FULL JOIN last l ON o.id = l.id AND o.k = l.k)
SELECT id, string_agg(k || '=' || v, ';' ORDER BY k) AS properties FROM m GROUP BY id""")
def node_upsert(s, d):
    """Customers' properties merged with those of their orders, of which the last wins."""
    c, o = load(s, d, "customer"), load(s, d, "orders")
    old = c.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("properties"))
    new = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.create_map(F.lit("last_order"), F.col("o_orderkey").cast("string"), F.lit("segment"), F.col("o_orderpriority")).alias("properties"))
    m = M.merge_nodes(old, new, "id", "ord")
    return m.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("properties"))


@query(f"WITH {_NODES}, {_ALL}, gone AS (SELECT id FROM nodes WHERE type = 'nation' AND confidence < 0.7) SELECT rel, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY rel UNION ALL SELECT 'nodes', count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone)")
def node_detach_delete(s, d):
    n = G.nodes(s, d)
    kept, e = M.detach_delete(n, G.edges(s, d), n.where("type = 'nation' AND confidence < 0.7"))
    return e.groupBy("rel").agg(_n().alias("n")).unionByName(kept.select(F.lit("nodes").alias("rel")).groupBy("rel").agg(_n().alias("n")))


def _new_edges(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "customer").select(_id("c", "c_custkey").alias("src"), F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string")).alias("dst"), F.lit("visited").alias("rel"))


@query("WITH g AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'located_in' AS rel FROM supplier) SELECT * FROM g UNION ALL SELECT 'c' || c_custkey, 'n' || (c_custkey % 40), 'visited' FROM customer WHERE c_custkey % 40 IN (SELECT n_nationkey FROM nation)")
def edge_create(s, d):
    g = load(s, d, "supplier").select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst"), F.lit("located_in").alias("rel"))
    return M.create_edges(g, _new_edges(s, d), G.nodes(s, d))


@query("SELECT 'c' || c_custkey AS src, 'n' || (c_custkey % 40) AS dst, 'visited' AS rel FROM customer WHERE c_custkey % 40 NOT IN (SELECT n_nationkey FROM nation)")
def edge_rejects(s, d):
    return M.dangling(_new_edges(s, d), G.nodes(s, d))


@query(f"WITH {_NODES} SELECT id, name, type, NULL::VARCHAR AS brand FROM nodes WHERE type = 'nation' UNION ALL SELECT 'b' || p_partkey, p_name, NULL, p_brand FROM part")
def bulk_import(s, d):
    new = load(s, d, "part").select(_id("b", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return M.import_nodes(G.nodes(s, d).where("type = 'nation'").select("id", "name", "type"), new)


@query("""SELECT c_custkey, CASE WHEN o.p IS NOT NULL THEN o.p ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def upsert_last_of_many(s, d):
    c = load(s, d, "customer").select("c_custkey", "c_mktsegment")
    new = load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return M.upsert_last(c, new, "c_custkey", [F.col("o_orderkey")]).join(c.select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, NULL::BIGINT AS chunk_index, md5(text) AS content_hash, n_chars AS size, 'document' AS kind FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, i // 1000, md5(array_to_string(w[i + 1:i + 1000], ' ')), len(w[i + 1:i + 1000]), 'chunk' FROM (SELECT doc_id, w, unnest(range(0, len(w), 1000)) AS i FROM w)""")
def store_output(s, d):
    """What the pipeline stores: a document row, and a row per chunk of 1000 words with its token count."""
    t = load(s, d, "documents").where("text IS NOT NULL")
    docs = t.select("doc_id", F.lit(None).cast("long").alias("chunk_index"), F.md5(F.col("text").cast("binary")).alias("content_hash"), F.col("n_chars").cast("long").alias("size"), F.lit("document").alias("kind"))
    c = t.select("doc_id", F.posexplode(X.word_chunks(F.col("text"))).alias("pos", "c"))
    return docs.unionByName(c.select("doc_id", F.col("pos").cast("long").alias("chunk_index"), F.md5(F.col("c").cast("binary")).alias("content_hash"), X.token_count(F.col("c")).cast("long").alias("size"), F.lit("chunk").alias("kind")))


@query("""WITH t AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) SELECT conv_id, turn, role, md5(text) AS digest FROM conversations
UNION ALL SELECT conv_id, m + 1, 'user', md5('and then?') FROM t UNION ALL SELECT conv_id, m + 2, 'assistant', md5('then nothing') FROM t""")
def conversation_append(s, d):
    """Two messages, of the user and the assistant, after the last turn of each conversation."""
    c = load(s, d, "conversations")
    pair = F.array(F.struct(F.lit(1).alias("step"), F.lit("user").alias("role"), F.lit("and then?").alias("text")), F.struct(F.lit(2).alias("step"), F.lit("assistant").alias("role"), F.lit("then nothing").alias("text")))
    new = c.groupBy("conv_id").agg(F.max("turn").alias("m")).select("conv_id", "m", F.explode(pair).alias("x")).select("conv_id", (F.col("m") + F.col("x.step")).alias("turn"), "x.role", "x.text")
    return c.select("conv_id", "turn", "role", "text").unionByName(new).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, 1 + (conv_id + turn) % 5 AS rating, CASE WHEN 1 + (conv_id + turn) % 5 >= 4 THEN 'positive' WHEN 1 + (conv_id + turn) % 5 <= 2 THEN 'negative' ELSE 'neutral' END AS feedback_type FROM conversations WHERE role = 'assistant'")
def feedback_append(s, d):
    """Ratings of 1 to 5 of existing answers; others are refused."""
    c = load(s, d, "conversations")
    given = c.select("conv_id", "turn", (1 + (F.col("conv_id") + F.col("turn")) % 5).alias("rating")).unionByName(c.select("conv_id", "turn", F.lit(9).cast("long").alias("rating")))
    r = F.col("rating")
    sound = given.where(r.between(1, 5)).join(c.where("role = 'assistant'").select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    return sound.select("conv_id", "turn", "rating", F.when(r >= 4, "positive").when(r <= 2, "negative").otherwise("neutral").alias("feedback_type"))


# ---- exports


@query("SELECT conv_id, md5(to_json(list({'role': role, 'turn': turn, 'content': text} ORDER BY turn))) AS digest FROM conversations GROUP BY conv_id")
def export_chat_json(s, d):
    """Each conversation's messages in order as one JSON text, with their contents."""
    one = F.struct("turn", F.struct("role", "turn", F.col("text").alias("content")).alias("x"))
    j = F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["x"]), {"ignoreNullFields": "false"})
    return load(s, d, "conversations").groupBy("conv_id").agg(F.md5(j.cast("binary")).alias("digest"))


@query("""WITH h AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE text ILIKE '%the%')
SELECT source, md5('# Results' || chr(10) || string_agg('## ' || rn || '. ' || doc_id || chr(10) || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END, chr(10) ORDER BY rn)) AS digest FROM h WHERE rn <= 20 GROUP BY source""")
def export_search_markdown(s, d):
    """The first twenty hits of each source as a page."""
    h = load(s, d, "documents").where(F.col("text").ilike("%the%")).withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("rn <= 20")
    one = F.struct("rn", F.concat(F.lit("## "), F.col("rn").cast("string"), F.lit(". "), F.col("doc_id").cast("string"), F.lit("\n"), X.preview(F.col("text"))).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["x"]), "\n")
    return h.groupBy("source").agg(F.md5(F.concat(F.lit("# Results\n"), body).cast("binary")).alias("digest"))


# ---- filters and listings


@query("""SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
AND o_orderdate BETWEEN (SELECT min(o_orderdate) + INTERVAL 100 DAY FROM orders) AND (SELECT min(o_orderdate) + INTERVAL 900 DAY FROM orders) AND list_has_all([o_orderstatus, c_mktsegment], ['O']) AND o_totalprice >= 1000""")
def search_filters_all(s, d):
    """Categories, content types, a range of dates, tags of which all must be there, and a least quality."""
    o = load(s, d, "orders").join(load(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    first = load(s, d, "orders").agg(F.min("o_orderdate").alias("m"))
    t = o.join(F.broadcast(first)).withColumn("tags", F.array("o_orderstatus", "c_mktsegment"))
    f = R.SearchFilters(categories=["BUILDING", "MACHINERY"], content_types=["1-URGENT", "2-HIGH", "3-MEDIUM"], tags=["O"], quality_min=1000)
    t = t.withColumnsRenamed({"c_mktsegment": "category", "o_orderpriority": "content_type", "o_totalprice": "quality_score"})
    return t.where(f.condition() & F.col("o_orderdate").between(F.col("m") + F.expr("INTERVAL 100 DAYS"), F.col("m") + F.expr("INTERVAL 900 DAYS"))).select("o_orderkey")


@query("SELECT doc_id, coalesce(quality, 0) AS quality_score FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) WHERE coalesce(quality, 0) >= 0.3")
def quality_filter(s, d):
    """A missing score counts as 0."""
    l = load(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    q = F.coalesce("quality", F.lit(0))
    return load(s, d, "documents").join(l, "doc_id", "left").where(q >= 0.3).select("doc_id", q.alias("quality_score"))


@query(f"WITH {_NODES} SELECT id, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, id) AS rn FROM nodes WHERE confidence >= 0.5) WHERE rn <= 100")
def confidence_limits(s, d):
    """Entities from a confidence of 0.5 on, at most a hundred of each type."""
    w = W.partitionBy("type").orderBy(F.desc("confidence"), "id")
    return G.nodes(s, d).where("confidence >= 0.5").withColumn("rn", F.row_number().over(w)).where("rn <= 100").select("id", "type")


@query(f"WITH {_NODES} SELECT id, name, type FROM nodes WHERE type IN ('nation', 'supplier') AND confidence >= 0.75")
def export_filter(s, d):
    return G.nodes(s, d).where("type IN ('nation', 'supplier') AND confidence >= 0.75").select("id", "name", "type")


@query("""WITH p AS (SELECT 's' || s_suppkey AS id, s_name AS name, [lower(s_name), upper(s_name), replace(s_name, '#', '')] AS aliases, s_nationkey::VARCHAR AS nation FROM supplier)
SELECT id, name FROM p WHERE list_contains(aliases, (SELECT lower(s_name) FROM supplier WHERE s_suppkey = 5)) OR (nation = '3' AND contains(name, '1'))""")
def entity_filter_alias(s, d):
    """By alias, or by property and part of the name."""
    n = F.col("s_name")
    p = load(s, d, "supplier").select(_id("s", "s_suppkey").alias("id"), n.alias("name"), F.array(F.lower(n), F.upper(n), F.replace(n, F.lit("#"), F.lit(""))).alias("aliases"), F.col("s_nationkey").cast("string").alias("nation"))
    want = load(s, d, "supplier").where("s_suppkey = 5").select(F.lower("s_name").alias("alias"))
    hit = F.array_contains(F.col("aliases"), F.col("alias")) | ((F.col("nation") == "3") & F.col("name").contains("1"))
    return p.join(F.broadcast(want)).where(hit).select("id", "name")


@query("SELECT 'c' || c_custkey AS id, c_name AS name FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS confidence FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE contains(lower(c_name), '#00') AND confidence >= 1000")
def entity_filter_optional(s, d):
    """The optional confidence is null for customers without orders, who fail the filter."""
    c = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("confidence"))
    return load(s, d, "customer").join(c, "c_custkey", "left").where(F.lower("c_name").contains("#00") & (F.col("confidence") >= 1000)).select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("name"))


@query(f"WITH {_NODES} SELECT id, name, type FROM nodes WHERE contains(name, 'r') AND type = 'part' ORDER BY id LIMIT 50")
def node_search(s, d):
    return G.nodes(s, d).where(F.col("name").contains("r") & (F.col("type") == "part")).orderBy("id").limit(50).select("id", "name", "type")


@query("SELECT (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT lang AS x FROM documents)) AS languages, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT source AS x FROM documents)) AS sources, (SELECT min(ts) FROM events) AS date_from, (SELECT max(ts) FROM events) AS date_to")
def available_filters(s, d):
    names = lambda c, a: load(s, d, "documents").agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(a))
    return names("lang", "languages").join(names("source", "sources")).join(load(s, d, "events").agg(F.min("ts").alias("date_from"), F.max("ts").alias("date_to")))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def listing_of_owner(s, d):
    """What its owner may see, filtered and paged."""
    o = R.matching(load(s, d, "orders"), o_custkey=7, o_orderstatus=["O", "P"])
    return R.page(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], 20, 0).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT c.conv_id, turn FROM conversations c WHERE c.conv_id % 4 <> 1")
def delete_sessions(s, d):
    """Sessions of one owner go, with their messages."""
    c = load(s, d, "conversations")
    return M.delete(c.select("conv_id", "turn"), c.where("conv_id % 4 = 1").select("conv_id").distinct(), "conv_id")


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, i // 100 AS chunk_index, len(w[i + 1:i + 100]) AS n FROM (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS i FROM w))
SELECT d.doc_id, count(c.chunk_index) AS chunks, coalesce(string_agg(c.n::VARCHAR, ',' ORDER BY chunk_index), '') AS token_counts FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def document_with_chunks(s, d):
    """Documents with their chunks in order; those without chunks stay."""
    t = load(s, d, "documents").select("doc_id", "text")
    c = t.select("doc_id", F.posexplode(X.word_chunks(F.col("text"), 100)).alias("chunk_index", "c")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", X.token_count(F.col("c")).alias("n")))).alias("l"))
    j = t.select("doc_id").join(c, "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("chunks"), F.coalesce(F.array_join(F.transform("l", lambda x: x["n"].cast("string")), ","), F.lit("")).alias("token_counts"))


# ---- statistics


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM orders) AS jobs,
(SELECT string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)) AS by_status,
(SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS last_day, (SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS last_week""")
def statistics_whole(s, d):
    """Four counts, the distribution of statuses and two recent counts, in one row."""
    n = lambda t, a: load(s, d, t).agg(_n().alias(a))
    by = load(s, d, "orders").groupBy("o_orderstatus").agg(_n().alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))), lambda x: F.concat(x["o_orderstatus"], F.lit(":"), x["n"].cast("string"))), ",").alias("by_status"))
    e = load(s, d, "events")
    since = lambda i: F.count_if(F.col("ts") >= F.col("m") - F.expr(i))
    recent = e.join(F.broadcast(e.agg(F.max("ts").alias("m")))).agg(since("INTERVAL 24 HOURS").alias("last_day"), since("INTERVAL 7 DAYS").alias("last_week"))
    return n("documents", "documents").join(n("pages", "pages")).join(n("conversations", "messages")).join(n("orders", "jobs")).join(by).join(recent)


@query(f"WITH {_ALL}, {_BOTH} SELECT rel, count(*) AS n FROM both_ways GROUP BY rel")
def relation_count_undirected(s, d):
    """Each edge from both of its ends."""
    return G.both_ways(G.edges(s, d)).groupBy("rel").agg(_n().alias("n"))


@query(f"WITH {_NODES}, l AS (SELECT id, unnest(['Entity', type]) AS label FROM nodes) SELECT label, count(*) AS n FROM l GROUP BY label UNION ALL SELECT 'type:' || type, count(*) FROM nodes GROUP BY type")
def graph_label_statistics(s, d):
    """Nodes by each label of their label sets, and by type."""
    n = G.nodes(s, d)
    by = n.select(F.explode(F.array(F.lit("Entity"), F.col("type"))).alias("label")).groupBy("label").agg(_n().alias("n"))
    return by.unionByName(n.groupBy(F.concat(F.lit("type:"), F.col("type")).alias("label")).agg(_n().alias("n")))


@query("SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def collect_distinct(s, d):
    return load(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS running, round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0), 6) AS success_rate FROM orders")
def job_stats(s, d):
    of = lambda x: F.count_if(F.col("o_orderstatus") == x)
    return load(s, d, "orders").agg(_n().alias("total"), of("F").alias("completed"), of("P").alias("failed"), of("O").alias("running"), F.round(F.try_divide(of("F"), _n()), 6).alias("success_rate"))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS median, grouping(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def status_cube(s, d):
    c = load(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(_n().alias("n"), F.median("o_totalprice").alias("median"), F.grouping_id().alias("level"))
    return c.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "median", "level")


@query("""WITH m AS (SELECT conv_id, turn, role, substr(text, 1, 200) AS cut, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, md5(string_agg(role || ': ' || cut, chr(10) ORDER BY turn)) AS context, bool_or(contains(lower(cut), 'data')) AS about_data, bool_or(contains(lower(cut), 'the')) AS about_the FROM m WHERE rn <= 5 GROUP BY conv_id""")
def conversation_context(s, d):
    """The last five messages, cut at 200 characters, with flags of their topics."""
    m = R.last_n(load(s, d, "conversations"), "conv_id", "turn", 5).withColumn("cut", F.substring("text", 1, 200))
    one = F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("cut")).alias("x"))
    about = lambda w: F.coalesce(F.bool_or(F.lower("cut").contains(w)), F.lit(False))
    return m.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["x"]), "\n").cast("binary")).alias("context"), about("data").alias("about_data"), about("the").alias("about_the"))


@query("""WITH m AS (SELECT c_name AS name, c_mktsegment AS type, c_custkey AS pos FROM customer UNION ALL SELECT upper(c_name), c_mktsegment, c_custkey + 1000000 FROM customer UNION ALL SELECT p_name, p_type, p_partkey FROM part)
SELECT name, type, pos FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), type ORDER BY pos) AS rn FROM m) WHERE rn = 1""")
def entity_dedup(s, d):
    """The first of each name, in any case, and type."""
    c, p = load(s, d, "customer"), load(s, d, "part")
    a = c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_custkey").alias("pos"))
    m = a.unionByName(a.select(F.upper("name").alias("name"), "type", (F.col("pos") + 1000000).alias("pos"))).unionByName(p.select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_partkey").alias("pos")))
    m = m.withColumn("key", F.lower("name"))
    return R.first_by(m, ["key", "type"], [F.col("pos")]).select("name", "type", "pos")


@query("""WITH r AS (SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS rel, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) SELECT src, dst, rel, min(pos) AS pos FROM r GROUP BY ALL""")
def relation_dedup(s, d):
    """The first of each source, target and relation."""
    r = load(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return r.groupBy("src", "dst", "rel").agg(F.min("pos").alias("pos"))


@query("SELECT event_id, 'k=' || CASE WHEN event_id % 2 = 0 THEN '0' ELSE (props::JSON ->> 'k') END || ';type=' || event_type AS merged FROM events")
def dict_merge(s, d):
    """Right-biased merge of maps: even events overwrite k."""
    base = F.from_json("props", "map<string,string>")
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("0"), F.lit("type"), F.col("event_type"))).otherwise(F.create_map(F.lit("type"), F.col("event_type")))
    m = X.map_merge(base, over)
    return load(s, d, "events").select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query("SELECT s_suppkey AS \"supplier.key\", s_name AS \"supplier.name\", s_nationkey AS \"supplier.at.nation\", s_acctbal AS balance FROM supplier")
def dict_flatten(s, d):
    """Nested structs as columns with dotted names."""
    n = load(s, d, "supplier").select(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation")).alias("at")).alias("supplier"), F.col("s_acctbal").alias("balance"))
    return X.flatten(n)
