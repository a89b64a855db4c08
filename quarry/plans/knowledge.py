"""Extraction of entities and relations, and the graph built from them: queries with their SQL.

The prose of the tables names no satellites, so each supplier has a short note, made by the
same expression in both dialects, and parts give the rows of a table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.functions import text as X
from quarry.operators import extraction as E
from quarry.operators import graph as G
from quarry.operators import vector as V
from quarry.plans.catalogue import _ALL, _BOTH, _GEO, _NODES, load, query


def _pick(by: str, *values: str) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_K = "s_suppkey"
#: A note on each supplier's number, in SQL that both dialects read.
NOTE = " || ".join(
    [
        "'INSAT-'", f"CAST({_K} % 7 + 1 AS STRING)", _pick(_K, "A", "B", ""), "' '", _pick(_K, "carries", "features", "has an", "no longer carries"), "' '", _pick(_K, "VHRR", "imager", "sounder", "CCD", "radiometer"),
        "'. The '", _pick(f"({_K} + 1)", "VHRR", "Imager", "sounder", "CCD", "altika"), "' '", _pick(_K, "measures", "observes", "may detect", "monitors"), "' '", _pick(_K, "SST", "humidity", "sea surface temperature", "aerosol", "ozone", "wind speed"),
        "'. kalpana-1 observes '", _pick(f"({_K} + 2)", "India", "bay of bengal", "Arabian Sea", "Mumbai"), "' and RISAT-2B operated by '", _pick(_K, "ISRO", "NRSC", "isro"), "' since '", f"CAST(2000 + {_K} % 20 AS STRING)",
        "'. '", _pick(f"({_K} + 3)", "SST used for oceanography", "humidity used for meteorology", "Chennai, India", "primary mission: geostationary orbit", "launched on 12-05-2011 at 700 km altitude"), "'.'",
    ]
)
_NOTES = f"notes AS (SELECT s_suppkey AS doc_id, {NOTE} AS text FROM supplier)"


def notes(s: SparkSession, d: str) -> DataFrame:
    """A note on each supplier, dealt over all cores: the table is a small file, which one task would read and work on alone."""
    n = load(s, d, "supplier").repartition(4 * s.sparkContext.defaultParallelism)
    return n.select(F.col("s_suppkey").alias("doc_id"), F.expr(NOTE).alias("text"))


_VARIANTS = ", ".join(f"('{c}', '{v}')" for c, ws in fixed.TERMS.items() for w in ws for v in E.term_variants(w))
_TERMS = f"terms AS (SELECT DISTINCT doc_id, category, term FROM notes, (VALUES {_VARIANTS}) g(category, term) WHERE contains(lower(text), term))"


@query(f"WITH {_NOTES}, {_TERMS} SELECT doc_id, category, term FROM terms")
def technical_terms_all(s, d):
    """Four categories, with the variants of their terms."""
    return notes(s, d).select("doc_id", F.explode(E.technical_terms(F.col("text"))).alias("x")).select("doc_id", "x.category", "x.term")


def _sql_matches(patterns) -> str:
    return _concat([f"regexp_extract_all(lower(text), '{p}', {1 if re.compile(p).groups else 0})" for p in patterns])


def _concat(parts: list[str]) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


_INFO = {"satellites": fixed.SATELLITES, "launches": fixed.LAUNCHES, "orbits": fixed.ORBITS, "missions": fixed.MISSIONS}


@query(f"WITH {_NOTES}, {_TERMS}, o AS (SELECT doc_id, string_agg(term, ',' ORDER BY term) FILTER (category = 'instruments') AS instruments, string_agg(term, ',' ORDER BY term) FILTER (category = 'parameters') AS parameters FROM terms GROUP BY 1) SELECT notes.doc_id, " + ", ".join(f"array_to_string({_sql_matches(p)}, ',') AS {k}" for k, p in _INFO.items()) + ", coalesce(instruments, '') AS instruments, coalesce(parameters, '') AS parameters FROM notes LEFT JOIN o ON o.doc_id = notes.doc_id")
def satellite_info(s, d):
    """Six arrays; a pattern with a group gives the group, as the number of a satellite."""
    i = notes(s, d).select("doc_id", E.satellite_info(F.col("text")).alias("i"))
    plain = [F.array_join(f"i.{k}", ",").alias(k) for k in _INFO]
    return i.select("doc_id", *plain, *(F.array_join(F.array_sort(f"i.{k}"), ",").alias(k) for k in ("instruments", "parameters")))


_MENTIONS = f"mentions AS (SELECT doc_id, trim(name) AS name, type, pattern FROM ({' UNION ALL '.join(f'''SELECT doc_id, '{k}' AS type, {i} AS pattern, unnest(regexp_extract_all(text, '(?i){p}')) AS name FROM notes''' for k, ps in fixed.ENTITY_PATTERNS.items() for i, p in enumerate(ps))}) WHERE length(trim(name)) >= 3)"


@query(f"WITH {_NOTES}, {_MENTIONS} SELECT doc_id, name, type, pattern, count(*) AS n FROM mentions GROUP BY ALL")
def pattern_entities(s, d):
    """Every match of the 84 entity patterns."""
    m = E.pattern_mentions(notes(s, d))
    return m.groupBy("doc_id", "name", "type", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NOTES}, {_MENTIONS} SELECT doc_id, name, type, min(instr(text, name) - 1) AS start FROM mentions JOIN notes USING (doc_id) GROUP BY ALL")
def entity_positions(s, d):
    """The first place of each spelling."""
    return E.pattern_mentions(notes(s, d)).groupBy("doc_id", "name", "type").agg(F.min("start").cast("long").alias("start"))


_DESCRIBE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.DESCRIPTIONS.items()) + " ELSE 'Entity of type ' || type || ': ' END || name"


@query(f"""WITH {_NOTES}, {_TERMS}, e AS (SELECT DISTINCT doc_id, category, rtrim(category, 's') AS type, term AS name FROM terms)
SELECT doc_id, name, type, {_DESCRIBE.replace("CASE type", "CASE category").replace("type || ", "category || ")} AS description, array_to_string(list_sort(list_distinct([lower(name), upper(name)])), ',') AS aliases FROM e""")
def entities_from_terms(s, d):
    """Technical terms as entities: the category without its plural, with a description and aliases."""
    t = notes(s, d).select("doc_id", F.explode(E.technical_terms(F.col("text"))).alias("x")).select("doc_id", F.col("x.category").alias("category"), F.col("x.term").alias("name"))
    name = F.col("name")
    return t.select("doc_id", "name", F.rtrim(F.col("category"), F.lit("s")).alias("type"), E.description(name, F.col("category")).alias("description"), F.array_join(F.array_sort(F.array_distinct(F.array(F.lower(name), F.upper(name)))), ",").alias("aliases"))


_COUNT = "(length(lower(text)) - length(replace(lower(text), lower({0}), ''))) // length({0})"


@query(f"""WITH {_NOTES}, {_MENTIONS}, e AS (SELECT DISTINCT doc_id, lower(name) AS lname, type FROM mentions), c AS (SELECT e.*, {_COUNT.format('lname')} AS n, lname IN {tuple(v for ws in fixed.TERMS.values() for w in ws for v in E.term_variants(w))} AS technical FROM e JOIN notes USING (doc_id))
SELECT doc_id, lname, type, round(least(1.0, 0.8 + CASE WHEN n > 1 THEN least(0.1 * n, 0.2) ELSE 0 END + 0.1 + CASE WHEN technical THEN 0.1 ELSE 0 END), 6)::DOUBLE AS confidence FROM c""")
def entity_confidence(s, d):
    """Of pattern entities: repeated ones and technical terms have more."""
    n = notes(s, d)
    e = E.entities(E.pattern_mentions(n)).join(n, "doc_id")
    terms = [v for ws in fixed.TERMS.values() for w in ws for v in E.term_variants(w)]
    return e.select("doc_id", "lname", "type", E.entity_confidence(E.occurrences(F.col("text"), F.col("lname")), F.lit(True), F.col("lname").isin(*terms)).alias("confidence"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*')) AS name FROM documents")
def named_entities(s, d):
    """Runs of capitalised words."""
    return load(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*"), F.lit(0))).alias("name"))


_ONTOLOGY = "onto(rel, src_type, dst_type, ord) AS (VALUES " + ", ".join(f"('{r}', '{a}', '{b}', {i})" for i, (r, ss, ts) in enumerate(fixed.RELATIONS) for a in ss for b in ts) + ")"


@query(f"WITH {_NOTES}, {_MENTIONS}, {_ONTOLOGY}, t AS (SELECT DISTINCT doc_id, type FROM mentions) SELECT a.doc_id, a.type AS src_type, b.type AS dst_type, arg_min(rel, ord) AS rel FROM t a JOIN t b ON a.doc_id = b.doc_id JOIN onto ON src_type = a.type AND dst_type = b.type GROUP BY ALL")
def ontology_lookup(s, d):
    """The first relation that the ontology declares between the types of a document."""
    t = E.pattern_mentions(notes(s, d)).select("doc_id", "type").distinct()
    p = t.select("doc_id", F.col("type").alias("src_type")).join(t.select("doc_id", F.col("type").alias("dst_type")), "doc_id")
    return E.inferred(p).select("doc_id", "src_type", "dst_type", "rel")


@query(f"WITH {_ONTOLOGY}, g AS (SELECT rel AS r, t AS a, u AS b FROM (SELECT DISTINCT rel FROM onto UNION ALL SELECT 'developed_by'), (VALUES {', '.join(f'({k!r})' for k in fixed.PARENTS)}) x(t), (VALUES {', '.join(f'({k!r})' for k in fixed.PARENTS)}) y(u)) SELECT r AS rel, a AS src_type, b AS dst_type FROM g WHERE EXISTS (SELECT 1 FROM onto WHERE rel = r AND src_type = a AND dst_type = b)")
def relation_validation(s, d):
    """Of every relation between every two types, those that the ontology allows."""
    kinds = s.createDataFrame([(k,) for k in fixed.PARENTS], "k string")
    rels = s.createDataFrame([(r[0],) for r in fixed.RELATIONS] + [("developed_by",)], "rel string")
    every = rels.crossJoin(kinds.select(F.col("k").alias("src_type"))).crossJoin(kinds.select(F.col("k").alias("dst_type")))  # fixed values only
    return E.validated(every).select("rel", "src_type", "dst_type")


@query("SELECT name AS type, parent AS super_type FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in fixed.PARENTS.items()) + ") h(name, parent) WHERE name <> parent")
def ontology_parents(s, d):
    return s.createDataFrame(list(fixed.PARENTS.items()), "type string, super_type string").where("type <> super_type")


@query(f"""WITH {_NOTES}, f AS ({" UNION ALL ".join(f"SELECT doc_id, text, '{rel}' AS rel, '{a}' AS src_type, '{b}' AS dst_type, regexp_extract(m, '{p}', 1) AS source, regexp_extract(m, '{p}', 2) AS target, m FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{p}')) AS m FROM notes)" for rel, i, a, b, p in E.relation_patterns())})
SELECT DISTINCT doc_id, rel, src_type, dst_type, source, target FROM f WHERE NOT regexp_matches(substr(text, greatest(instr(text, m) - 50, 1), (instr(text, m) - greatest(instr(text, m) - 50, 1))::BIGINT), '(?i){"|".join(fixed.NEGATIVE)}')""")
def pattern_relations(s, d):
    """Relation patterns with the entity patterns filled in, less negated matches."""
    return E.pattern_relations(notes(s, d)).select("doc_id", "rel", "src_type", "dst_type", "source", "target").distinct()


@query()
def relation_properties(s, d):
    """Pattern relations with their context, years and confidence."""
    n = notes(s, d)
    r = E.pattern_relations(n).join(n, "doc_id")
    often = lambda c: E.occurrences(F.col("text"), F.col(c))
    conf = E.relation_confidence(F.lit(0.8), F.lit("pattern_matching"), F.col("context"), often("source"), often("target"))
    return r.select("doc_id", "rel", "source", "target", F.array_join("temporal", ",").alias("years"), F.length("context").alias("context_length"), conf.alias("confidence"))


@query("""SELECT method, base, wide, often, round(least(base * CASE method WHEN 'pattern_matching' THEN 1.2 WHEN 'table_extraction' THEN 1.1 WHEN 'satellite_info' THEN 1.15 WHEN 'cooccurrence' THEN 0.8 ELSE 1 END * CASE WHEN wide THEN 1.1 ELSE 1 END * CASE WHEN often THEN 1.05 ELSE 1 END, 1), 6)::DOUBLE AS confidence
FROM (SELECT o_orderkey % 10 / 10.0 AS base, ['pattern_matching', 'table_extraction', 'satellite_info', 'cooccurrence', 'unknown'][(o_orderkey % 5 + 1)::BIGINT] AS method, o_custkey % 2 = 0 AS wide, o_orderkey % 3 = 0 AS often FROM orders)""")
def relation_confidence(s, d):
    """By method, width of context, and how often both ends occur."""
    k = F.col("o_orderkey")
    m = F.element_at(F.array(*(F.lit(x) for x in ("pattern_matching", "table_extraction", "satellite_info", "cooccurrence", "unknown"))), (k % 5 + 1).cast("int"))
    t = load(s, d, "orders").select((k % 10 / 10).alias("base"), m.alias("method"), (F.col("o_custkey") % 2 == 0).alias("wide"), (k % 3 == 0).alias("often"))
    n = F.when(F.col("often"), 2).otherwise(1)
    return t.select("method", "base", "wide", "often", E.relation_confidence(F.col("base"), F.col("method"), F.when(F.col("wide"), F.repeat(F.lit("x"), F.lit(51))).otherwise("x"), n, n).alias("confidence"))


@query(f"WITH {_NOTES}, {_TERMS} SELECT a.doc_id, a.term AS source, b.term AS target, 'has_instrument' AS rel FROM terms a JOIN terms b ON a.doc_id = b.doc_id WHERE a.category = 'satellites' AND b.category = 'instruments' UNION ALL SELECT a.doc_id, a.term, b.term, 'measures' FROM terms a JOIN terms b ON a.doc_id = b.doc_id WHERE a.category = 'instruments' AND b.category = 'parameters'")
def terms_cross_product(s, d):
    """Satellites with instruments and instruments with parameters, within each document."""
    n = notes(s, d)
    return E.terms_product(n, "satellites", "instruments", "has_instrument").unionByName(E.terms_product(n, "instruments", "parameters", "measures"))


def _cells(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "part")
    return p.select((F.col("p_partkey") % 5).alias("table"), F.col("p_partkey").alias("row"), F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("values"))


@query("WITH c AS (SELECT p_partkey % 5 AS t, p_partkey AS r, unnest([1, 3, 4]) AS i, unnest([p_name, p_type, p_size::VARCHAR]) AS v, unnest(['satellite', 'instrument', 'parameter']) AS k FROM part), p AS (SELECT a.t, a.r, a.v AS source, a.k AS src_type, b.v AS target, b.k AS dst_type FROM c a JOIN c b ON a.r = b.r AND a.i <> b.i), " + _ONTOLOGY + " SELECT t AS \"table\", r AS \"row\", source, target, arg_min(rel, ord) AS rel FROM p JOIN onto ON onto.src_type = p.src_type AND onto.dst_type = p.dst_type GROUP BY t, r, source, target, p.src_type, p.dst_type")
def table_cell_pairs(s, d):
    """Pairs of cells of a row whose headers name types that the ontology relates."""
    kinds = E.header_kinds(["Satellite name", "Brand", "Instrument type", "Parameter size"])
    return E.inferred(E.table_pairs(_cells(s, d), kinds)).select("table", "row", "source", "target", "rel")


@query(f"WITH {_NOTES}, {_MENTIONS}, k AS (SELECT s_suppkey AS id, 'INSAT-' || (s_suppkey % 7 + 1) AS name FROM supplier), a AS (SELECT id, unnest([lower(name), lower(replace(name, '-', ''))]) AS alias FROM k), f AS (SELECT alias, min(id) AS id FROM a GROUP BY 1), m AS (SELECT DISTINCT name FROM mentions) SELECT name, id FROM m LEFT JOIN f ON alias = lower(name)")
def alias_lookup(s, d):
    """Names resolved to the first entity with that name or alias, in any case."""
    name = F.concat(F.lit("INSAT-"), (F.col("s_suppkey") % 7 + 1).cast("string"))
    known = load(s, d, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name"), F.array(F.replace(name, F.lit("-"), F.lit(""))).alias("aliases"))
    return E.resolved(E.pattern_mentions(notes(s, d)).select("name").distinct(), known).select("name", "id")


@query()
def cooccurrence_relations(s, d):
    """Mentions within 200 characters whose types the ontology relates."""
    return E.cooccurring(E.pattern_mentions(notes(s, d))).select("doc_id", "source", "target", "rel", "distance")


@query(f"WITH {_NOTES}, {_MENTIONS} SELECT lower(name) || ':' || type AS id, min(name) AS name, type, count(DISTINCT doc_id) AS n_docs FROM mentions GROUP BY lower(name), type")
def graph_build_nodes(s, d):
    """Nodes of the graph built from all notes."""
    n = E.entities(E.pattern_mentions(notes(s, d)))
    return n.groupBy(F.concat("lname", F.lit(":"), "type").alias("id"), "type").agg(F.min("name").alias("name"), F.countDistinct("doc_id").alias("n_docs"))


@query()
def graph_build_edges(s, d):
    """Edges of the graph built from all notes; those with a missing end are dropped."""
    return E.build_graph(notes(s, d))[1]


@query(f"WITH {_NOTES}, {_MENTIONS} SELECT (SELECT count(*) FROM notes) AS documents, (SELECT count(DISTINCT (lower(name), type)) FROM mentions) AS entities, (SELECT count(*) FROM mentions) AS mentions")
def build_statistics(s, d):
    n = notes(s, d)
    m = E.pattern_mentions(n)
    return n.agg(F.count(F.lit(1)).alias("documents")).join(m.agg(F.countDistinct(F.lower("name"), "type").alias("entities"), F.count(F.lit(1)).alias("mentions")))


# ---- graph queries by template


#: Queries by name, each of (nodes, edges, parameters).
TEMPLATES = {
    "find_entities": lambda n, e, type, **_: n.where(F.col("type") == type),  # noqa: A002
    "find_relations": lambda n, e, rel, **_: e.where(F.col("rel") == rel),
    "find_neighbors": lambda n, e, id, direction="both", **_: G.neighbours(e, n, id, direction),  # noqa: A002
    "find_paths": lambda n, e, start, end, **kw: G.paths(e, start, end, **kw),
    "find_similar": lambda n, e, id, **_: G.similar_by_neighbours(e, n, id),  # noqa: A002
    "subgraph": lambda n, e, id, radius=2, **_: G.induced(e, G.within(e, id, radius).select("node")),  # noqa: A002
    "traversal": lambda n, e, start, **kw: G.traversal(e, n, start, **kw),
    "aggregate": lambda n, e, **_: n.groupBy("type").agg(F.count(F.lit(1)).alias("n")),
}


def run_template(nodes: DataFrame, edges: DataFrame, name: str, **params: object) -> DataFrame:
    """The query of that name; ValueError for another one."""
    if name not in TEMPLATES:
        raise ValueError(f"unknown query: {name}")
    return TEMPLATES[name](nodes, edges, **params)


def answered(nodes: DataFrame, edges: DataFrame, queries: list[tuple[str, dict]]) -> DataFrame:
    """query, row: the rows of several queries by name, each as JSON of its columns by name."""
    parts = [run_template(nodes, edges, name, **params) for name, params in queries]
    one = lambda name, df: df.select(F.lit(name).alias("query"), F.to_json(F.struct(*sorted(df.columns))).alias("row"))
    return reduce(DataFrame.unionByName, (one(q[0], df) for q, df in zip(queries, parts, strict=True)))


@query(f"""WITH RECURSIVE {_NODES}, {_GEO}, {_BOTH}, w AS (SELECT 's1' AS node, ['s1'] AS path, 0 AS depth UNION ALL SELECT dst, list_append(path, dst), depth + 1 FROM w JOIN both_ways ON src = node WHERE depth < 4 AND NOT list_contains(path, dst)), near AS (SELECT DISTINCT node FROM w WHERE depth <= 1),
b AS (SELECT DISTINCT src, dst, rel FROM both_ways), g AS (SELECT src AS id, count(DISTINCT dst) AS deg FROM b GROUP BY 1), sh AS (SELECT b.src AS id, count(DISTINCT b.dst) AS shared FROM b JOIN b m ON m.src = 's1' AND m.dst = b.dst AND m.rel = b.rel WHERE b.src <> 's1' GROUP BY 1)
SELECT 'find_entities' AS query, to_json({{'id': id, 'name': name, 'type': type}}) AS row FROM nodes WHERE type = 'nation' UNION ALL SELECT 'find_relations', to_json({{'dst': dst, 'rel': rel, 'src': src}}) FROM edges WHERE rel = 'located_in'
UNION ALL SELECT 'find_neighbors', to_json({{'id': id, 'name': name, 'rel': rel, 'type': type}}) FROM both_ways JOIN nodes ON id = dst WHERE src = 'n3'
UNION ALL SELECT 'find_paths', to_json({{'length': depth, 'path': p}}) FROM (SELECT depth, array_to_string(path, '>') AS p FROM w WHERE node = 's2' AND depth > 0 ORDER BY depth, p LIMIT 10)
UNION ALL SELECT 'find_similar', to_json({{'id': sh.id, 'shared': shared}}) FROM sh JOIN nodes USING (id) WHERE type = 'supplier'
UNION ALL SELECT 'subgraph', to_json({{'dst': dst, 'rel': rel, 'src': src}}) FROM edges WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)
UNION ALL SELECT 'traversal', to_json({{'distance': depth, 'id': id, 'name': name, 'path': p, 'type': type}}) FROM (SELECT DISTINCT depth, id, name, type, array_to_string(path, '>') AS p FROM w JOIN nodes ON id = node WHERE depth BETWEEN 1 AND 2 ORDER BY depth, name, p LIMIT 50)
UNION ALL SELECT 'aggregate', to_json({{'n': count(*), 'type': type}}) FROM nodes GROUP BY type""")
def template_dispatch(s, d):
    """The rows of all eight queries by name."""
    n, e = G.nodes(s, d).select("id", "name", "type"), G.geo_edges(s, d)
    queries = [("find_entities", {"type": "nation"}), ("find_relations", {"rel": "located_in"}), ("find_neighbors", {"id": "n3"}), ("find_paths", {"start": "s1", "end": "s2", "longest": 4}), ("find_similar", {"id": "s1"}), ("subgraph", {"id": "s1", "radius": 1}), ("traversal", {"start": "s1", "depth": 2}), ("aggregate", {})]
    out = answered(n, e, queries)
    # a similarity is a fraction, whose digits the two engines write differently
    return out.select("query", F.when(F.col("query") == "find_similar", F.regexp_replace("row", ',"similarity":[^,}]*', "")).otherwise(F.col("row")).alias("row"))


def _walk(depth: int) -> str:
    return f"{_GEO}, {_BOTH}, {_NODES}, w AS (SELECT 'n3' AS node, ['n3'] AS path, 0 AS depth UNION ALL SELECT dst, list_append(path, dst), depth + 1 FROM w JOIN both_ways ON src = node WHERE depth < {depth} AND NOT list_contains(path, dst))"


@query(f"WITH RECURSIVE {_walk(3)} SELECT DISTINCT id, name, type, depth AS distance, array_to_string(path, '>') AS path FROM w JOIN nodes ON id = node WHERE depth > 0 AND type IN ('nation', 'region') ORDER BY distance, name, path LIMIT 50")
def graph_traversal(s, d):
    """Trails of up to three steps that end at nations or regions, by distance and name."""
    return G.traversal(G.geo_edges(s, d), G.nodes(s, d), "n3", 3, ["nation", "region"])


@query(f"WITH RECURSIVE {_GEO}, {_BOTH}, w AS (SELECT 's1' AS node, ['s1'] AS path, 0 AS depth UNION ALL SELECT dst, list_append(path, dst), depth + 1 FROM w JOIN both_ways ON src = node WHERE rel IN ('located_in') AND depth < 4 AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, depth AS length FROM w WHERE node = 's2' AND depth >= 2 ORDER BY length, path LIMIT 10")
def find_paths_typed(s, d):
    """Paths of two to four steps over one type of relation."""
    return G.paths(G.geo_edges(s, d), "s1", "s2", 4, 10, 2, ["located_in"])


@query(f"WITH {_NODES}, {_GEO} SELECT n.id, e.dst, e.rel FROM nodes n LEFT JOIN (SELECT * FROM edges WHERE src LIKE 'n%' OR src LIKE 'r%') e ON e.src = n.id WHERE n.type IN ('nation', 'region')")
def typed_subgraph_with_isolates(s, d):
    """Nodes of some types with the edges among them; nodes without an edge stay."""
    n = G.nodes(s, d).where("type IN ('nation', 'region')")
    e = G.induced(G.geo_edges(s, d), n.select(F.col("id").alias("node")))
    return n.select("id").join(e.select(F.col("src").alias("id"), "dst", "rel"), "id", "left")


@query(f"""WITH {_NODES}, {_ALL}, r AS (SELECT DISTINCT s.name AS source, rel, t.name AS target, t.type AS target_type, c.conf FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst LEFT JOIN (SELECT 's' || s_suppkey AS id, s_acctbal AS conf FROM supplier WHERE s_acctbal > 0) c ON c.id = src WHERE rel = 'located_in' AND t.type = 'nation')
SELECT source, rel, target, target_type, conf FROM r""")
def find_relations_distinct(s, d):
    """Relations with an optional confidence, each once."""
    n = G.nodes(s, d)
    e = G.edges(s, d).where("rel = 'located_in'")
    conf = load(s, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.col("s_acctbal").alias("conf"))
    t = n.where("type = 'nation'").select(F.col("id").alias("dst"), F.col("name").alias("target"), F.col("type").alias("target_type"))
    return e.join(n.select(F.col("id").alias("src"), F.col("name").alias("source")), "src").join(t, "dst").join(conf, "src", "left").select("source", "rel", "target", "target_type", "conf").distinct()


# ---- retrieval


_SEM = "SELECT d.doc_id, d.text, d.source, round(1 - list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2))), 6) AS relevance FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY relevance DESC, d.doc_id LIMIT 15"


_KEY = "(SELECT doc_id, text, source FROM documents WHERE text ILIKE '%the%' ORDER BY doc_id LIMIT 15)"


@query(f"""WITH h AS (SELECT doc_id, text, source, round(relevance * 1.2, 6) AS score, 0 AS leg FROM ({_SEM}) UNION ALL SELECT doc_id, text, source, 0.8::DOUBLE, 1 FROM {_KEY}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source, '') || ':' || substr(coalesce(text, ''), 1, 100) ORDER BY leg, score DESC, doc_id) AS rn FROM h) WHERE rn = 1 ORDER BY score DESC, leg, doc_id LIMIT 15),
a AS (SELECT 'semantic' AS kind, doc_id, relevance AS score FROM (SELECT * FROM ({_SEM}) ORDER BY relevance DESC, doc_id LIMIT 10 OFFSET 5) UNION ALL SELECT 'keyword', doc_id, 0.8::DOUBLE FROM (SELECT * FROM {_KEY} ORDER BY doc_id LIMIT 10 OFFSET 5) UNION ALL SELECT 'hybrid', doc_id, score FROM (SELECT * FROM f ORDER BY score DESC, doc_id LIMIT 10 OFFSET 5))
SELECT * FROM a UNION ALL SELECT 'log:' || kind, NULL, count(*)::DOUBLE FROM a GROUP BY kind""")
def search_dispatch(s, d):
    """A page of each kind of search, and the log of the searches: kind and number of results."""
    docs, emb = load(s, d, "documents"), load(s, d, "embeddings")
    found = [V.search(docs, emb, k, 0, "the", 10, 5).select(F.lit(k).alias("kind"), "doc_id", "score") for k in ("semantic", "keyword", "hybrid")]
    log = [f.groupBy(F.concat(F.lit("log:"), "kind").alias("kind")).agg(F.lit(None).cast("long").alias("doc_id"), F.count(F.lit(1)).cast("double").alias("score")) for f in found]
    return reduce(DataFrame.unionByName, found + log)


@query("""WITH q AS (SELECT doc_id, string_split_regex(lower(source || ' ' || substr(text, 1, 500)), '\\s+') AS w FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL)), o AS (SELECT doc_id, string_split_regex(lower(source || ' ' || substr(text, 1, 500)), '\\s+') AS w FROM documents WHERE text IS NOT NULL)
SELECT o.doc_id, round(len(list_intersect(o.w, q.w)) / greatest(len(list_distinct(list_concat(o.w, q.w))), 1), 6) AS similarity FROM o, q WHERE o.doc_id <> q.doc_id ORDER BY similarity DESC, o.doc_id LIMIT 5""".replace("\\\\", "\\"))
def similar_by_head(s, d):
    """Documents nearest to one by title and first 500 characters; itself left out."""
    t = load(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.split(F.lower(F.concat_ws(" ", "source", F.substring("text", 1, 500))), r"\s+").alias("w"))
    q = t.orderBy("doc_id").limit(1).select(F.col("doc_id").alias("own"), F.col("w").alias("q"))
    return t.join(F.broadcast(q)).where("doc_id <> own").select("doc_id", F.round(X.jaccard(F.col("w"), F.col("q")), 6).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(5)


@query(f"""WITH {_NODES}, {_GEO}, {_BOTH}, r AS (SELECT n.name || ' (' || n.type || ') - ' || rel AS x, n.name, row_number() OVER (ORDER BY n.name) AS rn FROM both_ways JOIN nodes n ON n.id = dst WHERE src = 'n3'),
m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, md5((SELECT string_agg('[' || source || '] ' || substr(text, 1, 500), chr(10) ORDER BY relevance DESC, doc_id) FROM (SELECT * FROM ({_SEM}) ORDER BY relevance DESC, doc_id LIMIT 5)) || chr(10) || (SELECT string_agg(x, '; ' ORDER BY name) FROM r WHERE rn <= 5) || chr(10) || string_agg(x, chr(10) ORDER BY turn)) AS context FROM m WHERE rn <= 6 GROUP BY conv_id""")
def query_context(s, d):
    """The five nearest documents, five relations of an entity and the last six messages of each conversation, as one text."""
    near = V.semantic(load(s, d, "documents"), load(s, d, "embeddings"), 0, 5)
    block = F.struct((-F.col("relevance")).alias("r"), "doc_id", F.concat(F.lit("["), "source", F.lit("] "), F.substring("text", 1, 500)).alias("x"))
    docs = near.agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda v: v["x"]), "\n").alias("docs"))
    r = G.neighbours(G.geo_edges(s, d), G.nodes(s, d), "n3").orderBy("name").limit(5)
    rel = r.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", F.concat("name", F.lit(" ("), "type", F.lit(") - "), "rel").alias("x")))), lambda v: v["x"]), "; ").alias("relations"))
    w = E.ranked(load(s, d, "conversations"), ["conv_id"], [F.desc("turn")], 6)
    said = F.struct("turn", F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), "text").alias("x"))
    m = w.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda v: v["x"]), "\n").alias("said"))
    return m.join(F.broadcast(rel)).join(F.broadcast(docs)).select("conv_id", F.md5(F.concat("docs", F.lit("\n"), "relations", F.lit("\n"), "said").cast("binary")).alias("context"))


@query(f"""WITH {_NOTES}, {_TERMS}, rels AS (SELECT a.term AS x, b.term AS y FROM terms a JOIN terms b ON a.doc_id = b.doc_id WHERE a.category = 'satellites' AND b.category = 'instruments' GROUP BY ALL)
SELECT t.doc_id, t.term, string_agg(DISTINCT y, ',' ORDER BY y) AS related FROM terms t JOIN rels ON x = t.term GROUP BY ALL""")
def query_enhancement(s, d):
    """The terms of each text with the terms related to them in all texts."""
    n = notes(s, d)
    rels = E.terms_product(n, "satellites", "instruments", "has_instrument").select(F.col("source").alias("term"), "target").distinct()
    t = n.select("doc_id", F.explode(E.technical_terms(F.col("text"))).alias("x")).select("doc_id", F.col("x.term").alias("term"))
    return t.join(rels, "term").groupBy("doc_id", "term").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("related"))


@query("SELECT vec_id, len(embedding) AS size, md5(array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ',')) AS digest, 'stand-in' AS model FROM embeddings")
def vector_store(s, d):
    """Vectors saved with their metadata, others appended by key, and all loaded again, whole."""
    from quarry.sources import vectors
    from quarry.sources.staging import new_path

    e, path = load(s, d, "embeddings"), new_path(s, "vectors")
    vectors.save(e.where("vec_id % 2 = 0"), path, "stand-in", 64)
    vectors.append(e, path, "stand-in", 64)
    digits = F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000000).cast("string")), ",")
    return vectors.load(s, path).select("vec_id", F.size("embedding").cast("long").alias("size"), F.md5(digits.cast("binary")).alias("digest"), "model")


@query()
def intrinsic_dimension(s, d):
    return V.intrinsic_dimension(load(s, d, "embeddings"))


@query()
def clustering_quality(s, d):
    return V.clustering_quality(load(s, d, "embeddings"), k=5)


@query()
def embedding_by_md5(s, d):
    """A vector for each text, computed once for equal ones."""
    return V.embedded(load(s, d, "documents").select("doc_id", "text")).select("doc_id", "embedding")


@query("""SELECT p_partkey, p_name, levenshtein(p_name, 'red widget') AS distance, CASE WHEN contains(p_name, 'widget') THEN 1.5 ELSE 1.0 END / (1 + levenshtein(p_name, 'red widget')) AS score
FROM part WHERE levenshtein(p_name, 'red widget') <= 4 ORDER BY score DESC, p_partkey LIMIT 50""")
def fuzzy_search(s, d):
    """By edit distance, technical names boosted."""
    dist = F.levenshtein("p_name", F.lit("red widget"))
    t = load(s, d, "part").select("p_partkey", "p_name", dist.alias("distance")).where("distance <= 4")
    return t.withColumn("score", F.when(F.col("p_name").contains("widget"), 1.5).otherwise(1.0) / (1 + F.col("distance"))).orderBy(F.desc("score"), "p_partkey").limit(50)


@query("SELECT 'date' AS sort_by, o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20) UNION ALL SELECT 'quality', o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) UNION ALL SELECT 'title', o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 20)")
def search_sorting(s, d):
    o = load(s, d, "orders")
    by = {"date": F.desc("o_orderdate"), "quality": F.desc("o_totalprice"), "title": F.asc("o_orderpriority")}
    parts = [o.orderBy(c, "o_orderkey").limit(20).select(F.lit(k).alias("sort_by"), "o_orderkey") for k, c in by.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def group_similar_names(s, d):
    """Parts whose names' letters are alike, by min-hash buckets."""
    from pyspark.ml.feature import CountVectorizer, MinHashLSH

    p = load(s, d, "part").select("p_name").distinct().withColumn("w", F.split("p_name", " "))
    x = CountVectorizer(inputCol="w", outputCol="f", binary=True).fit(p).transform(p)
    m = MinHashLSH(inputCol="f", outputCol="h", numHashTables=3, seed=42).fit(x)
    j = m.approxSimilarityJoin(x, x, 0.7, "distance").where("datasetA.p_name < datasetB.p_name")
    return j.select(F.col("datasetA.p_name").alias("a"), F.col("datasetB.p_name").alias("b"), F.round("distance", 6).alias("distance"))
