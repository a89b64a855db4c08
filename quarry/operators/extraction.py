"""Entities and relations of texts: patterns, gazetteers, an ontology, and the graph built from them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.functions.text import bound, located

#: How pattern entities are made from what a pattern matches.
LEAST_LENGTH = 3
#: Characters before a match that may negate it, and around it that are its context.
BEFORE, AROUND = 50, 100
#: Mentions further apart than this don't co-occur.
NEAR = 200


def term_variants(term: str) -> tuple[str, ...]:
    """The spellings under which a term is looked for."""
    return tuple(dict.fromkeys((term, f"{term}s", f"{term}es", term.replace("-", " "), term.replace(" ", "-"))))


def shortest_variants(category: str) -> list[str]:
    """The variants of a category's terms that hold no other: a text that holds any variant holds one of these."""
    known = list(dict.fromkeys(v for w in fixed.TERMS[category] for v in term_variants(w)))
    return [v for v in known if not any(o != v and o in v for o in known)]


def technical_terms(text: Column) -> Column:
    """array<struct<category, term>> of the variants that the lower-cased text holds.

    The text is searched for the shortest variants once; longer ones are only looked for where what they hold is there.
    """
    words = list(dict.fromkeys((c, v) for c, terms in fixed.TERMS.items() for w in terms for v in term_variants(w)))
    roots = list(dict.fromkeys(r for c in fixed.TERMS for r in shortest_variants(c)))

    def found(t: Column, there: Column) -> Column:
        def hit(c: str, v: str) -> Column:
            known = there[next(i for i, r in enumerate(roots) if r in v)]
            return F.when(known if v in roots else known & t.contains(v), F.struct(F.lit(c).alias("category"), F.lit(v).alias("term")))

        return F.filter(F.array(*(hit(c, v) for c, v in words)), lambda x: x.isNotNull())

    return bound(F.lower(text), lambda t: bound(F.array(*(t.contains(r) for r in roots)), lambda there: found(t, there)))


def all_matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """What each pattern matches in the lower-cased text: its first group if it has one, else the match; in order of patterns."""
    found = [F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1 if re.compile(p).groups else 0)) for p in patterns]
    return F.concat(*found)


def satellite_info(text: Column) -> Column:
    """struct of six arrays: satellites, instruments, parameters, launches, orbits, missions."""
    of = lambda c: F.transform(F.filter(technical_terms(text), lambda x: x["category"] == c), lambda x: x["term"])
    return F.struct(
        all_matches(text, fixed.SATELLITES).alias("satellites"), of("instruments").alias("instruments"), of("parameters").alias("parameters"),
        all_matches(text, fixed.LAUNCHES).alias("launches"), all_matches(text, fixed.ORBITS).alias("orbits"), all_matches(text, fixed.MISSIONS).alias("missions"),
    )


def _by_pattern(docs: DataFrame, key: str, text: str, patterns: list[tuple], more: Callable[[Column, Column, Column], dict[str, Column]]) -> DataFrame:
    """key and, for every match of a pattern, kind, pattern (its number), src_type, dst_type, start, end and what ``more`` makes of (text, expression, match).

    A text is tested against each pattern and the matches of those that fit are placed, all in its own row: no copy of the text is made for a pattern or a match.
    """
    names = ("kind", "pattern", "src_type", "dst_type", "re")

    def places(t: Column) -> Column:
        tests = (F.when(t.rlike(p[-1]), F.struct(*(F.lit(v).alias(n) for n, v in zip(names, p, strict=True)))) for p in patterns)

        def found(p: Column) -> Column:
            row = lambda x: F.struct(*(p[n].alias(n) for n in names[:-1]), x["start"].alias("start"), x["end"].alias("end"), *(c.alias(n) for n, c in more(t, p["re"], x).items()))
            return F.transform(located(t, p["re"]), row)

        return F.flatten(F.transform(F.filter(F.array(*tests), lambda x: x.isNotNull()), found))

    return docs.select(key, F.inline(bound(F.col(text), places)))


def pattern_mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, name, type, pattern (its number within the type), start, end of every match of an entity pattern."""
    patterns = [(kind, i, kind, kind, f"(?i){p}") for kind, ps in fixed.ENTITY_PATTERNS.items() for i, p in enumerate(ps)]
    found = _by_pattern(docs, key, text, patterns, lambda t, p, x: {"name": F.trim(x["m"])}).select(key, "name", F.col("kind").alias("type"), "pattern", "start", "end")
    return found.where((F.length("name") >= LEAST_LENGTH) & ~F.lower("name").isin("the", "and", "for", "with"))


def entities(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first mention of each name (in any case) and type of a document, with their count."""
    by = [key, F.lower("name").alias("lname"), "type"]
    order = F.struct("start", "pattern", "name")
    return mentions.groupBy(*by).agg(F.min_by("name", order).alias("name"), F.min("start").alias("start"), F.countDistinct("start").alias("mentions"))


def description(name: Column, kind: Column) -> Column:
    out = F.concat(F.lit("Entity of type "), kind, F.lit(": "))
    for k, v in fixed.DESCRIPTIONS.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return F.concat(out, name)


def aliases(name: Column, kind: Column) -> Column:
    """Lower and upper case; for satellites also without hyphens and spaces. Sorted."""
    bare = F.regexp_replace(name, r"[-\s]", "")
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lower(name), F.upper(name)), F.when(kind == "satellite", F.array(bare, F.upper(bare))).otherwise(F.array().cast("array<string>")))))


def entity_confidence(count: Column, by_pattern: Column, technical: Column) -> Column:
    """0.8, more for repeated, patterned and technical entities, at most 1."""
    more = F.when(count > 1, F.least(count * 0.1, F.lit(0.2))).otherwise(0.0)
    tenth = lambda c: F.when(c, 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.lit(0.8) + more + tenth(by_pattern) + tenth(technical)), 6)


def occurrences(text: Column, word: Column) -> Column:
    """How often ``word`` occurs in ``text``, in any case and without overlaps."""
    t, w = F.lower(text), F.lower(word)
    return F.when(F.length(w) > 0, ((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("int")).otherwise(0)


def ontology(spark: SparkSession) -> DataFrame:
    """rel, src_type, dst_type, ord: every combination that a relation allows, in order of declaration."""
    rows = [(rel, a, b, i) for i, (rel, sources, targets) in enumerate(fixed.RELATIONS) for a in sources for b in targets]
    return spark.createDataFrame(rows, "rel string, src_type string, dst_type string, ord int")


def inferred(pairs: DataFrame) -> DataFrame:
    """``pairs`` (src_type, dst_type, ...) with the first relation that the ontology allows; others go."""
    o = ontology(pairs.sparkSession).groupBy("src_type", "dst_type").agg(F.min_by("rel", "ord").alias("rel"))
    return pairs.join(F.broadcast(o), ["src_type", "dst_type"])


def validated(relations: DataFrame) -> DataFrame:
    """Relations (rel, src_type, dst_type) that the ontology allows."""
    return relations.join(F.broadcast(ontology(relations.sparkSession).select("rel", "src_type", "dst_type")), ["rel", "src_type", "dst_type"], "left_semi")


def near_pairs(mentions: DataFrame, key: str = "doc_id", near: int = NEAR) -> DataFrame:
    """Ordered pairs of mentions of different names of a document, the second starting at most ``near`` characters after the first's end.

    A range join by bins of ``near`` characters, so a document's mentions aren't all paired.
    """
    bin_of = F.floor(F.col("end") / near)
    order = F.struct("start", "end", "type", "pattern")
    a = mentions.select(key, F.col("name").alias("source"), F.col("type").alias("src_type"), "end", order.alias("o1"), F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("bin"))
    b = mentions.select(key, F.col("name").alias("target"), F.col("type").alias("dst_type"), F.col("start").alias("start2"), order.alias("o2"), F.floor(F.col("start") / near).alias("bin"))
    return a.join(b, [key, "bin"]).where((F.col("o1") < F.col("o2")) & (F.col("start2") - F.col("end") <= near) & (F.col("start2") - F.col("end") > -near) & (F.col("source") != F.col("target"))).drop("bin")


def cooccurring(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, source, target, rel, distance: co-occurring mentions whose types the ontology relates; the nearest of each."""
    p = inferred(near_pairs(mentions, key)).withColumn("distance", F.col("start2") - F.col("end"))
    return p.groupBy(key, "source", "src_type", "target", "dst_type", "rel").agg(F.min("distance").alias("distance"))


def _named(kinds: str) -> str:
    """A non-capturing group of the entity patterns of the types between bars, their own groups made silent."""
    parts = [re.sub(r"\((?!\?)", "(?:", p) for k in kinds.split("|") for p in fixed.ENTITY_PATTERNS.get(k, ())]
    return "(?:" + "|".join(parts) + ")"


def relation_patterns() -> list[tuple[str, int, str, str, str]]:
    """(relation, number, type of the first group, type of the second, expression) with the placeholders filled in.

    Types for which no entity pattern exists can't match and are left out of alternatives.
    """
    out = []
    for rel, patterns in fixed.RELATION_PATTERNS.items():
        for i, p in enumerate(patterns):
            kinds = []
            for group in re.findall(r"\((\{[^)]*\})\)", p):
                known = [k for k in re.findall(r"\{(\w+)\}", group) if k in fixed.ENTITY_PATTERNS]
                kinds.append(known)
            for a in kinds[0]:
                for b in kinds[1]:
                    filled, n = p, 0
                    for group in re.findall(r"\(\{[^)]*\}\)", p):
                        filled = filled.replace(group, "(" + _named((a, b)[n]) + ")", 1)
                        n += 1
                    out.append((rel, i, a, b, f"(?i){filled}"))
    return out


def _around(t: Column, x: Column) -> dict[str, Column]:
    """What stands before a match, and the match with what is around it, in one line."""
    first, wide = F.greatest(x["start"] - BEFORE, F.lit(0)), F.greatest(x["start"] - AROUND, F.lit(0))
    return {"before": F.substring(t, first + 1, x["start"] - first), "context": F.trim(F.regexp_replace(F.substring(t, wide + 1, x["end"] + AROUND - wide), r"\s+", " "))}


def pattern_relations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every relation pattern that matches and isn't negated: key, source, src_type, target, dst_type, rel, start, context, and what the context states.

    temporal and spatial hold what their patterns name, quantitative numbers with units, and
    stated the properties (a map) that relations of this kind have.
    """

    def more(t: Column, p: Column, x: Column) -> dict[str, Column]:
        end = lambda n: F.trim(F.call_function("regexp_extract", x["m"], p, F.lit(n)))
        return {"source": end(1), "target": end(2), **_around(t, x)}

    found = _by_pattern(docs, key, text, relation_patterns(), more).where(~F.col("before").rlike("(?i)" + "|".join(fixed.NEGATIVE)))
    every = lambda patterns, group: F.concat(*(F.regexp_extract_all("context", F.lit(f"(?i){p}"), F.lit(group)) for p in patterns))
    amounts = F.transform(F.arrays_zip(every(fixed.QUANTITATIVE, 1).alias("n"), every(fixed.QUANTITATIVE, 2).alias("unit")), lambda q: F.concat_ws(" ", q["n"], q["unit"]))
    said = [F.when(F.col("kind") == rel, F.struct(F.lit(name).alias("key"), F.nullif(F.regexp_extract("context", f"(?i){p}", 1), F.lit("")).alias("value"))) for rel, ps in fixed.STATED.items() for name, p in ps]
    stated = F.map_from_entries(F.filter(F.array(*said), lambda x: x.isNotNull() & x["value"].isNotNull()))
    return found.select(
        key, "source", "src_type", "target", "dst_type", F.col("kind").alias("rel"), "pattern", "start", "context",
        every(fixed.TEMPORAL, 1).alias("temporal"), every(fixed.SPATIAL, 1).alias("spatial"), amounts.alias("quantitative"), stated.alias("stated"),
    )


def relation_confidence(base: Column, method: Column, context: Column, source_count: Column, target_count: Column) -> Column:
    by = F.when(method == "pattern_matching", 1.2).when(method == "table_extraction", 1.1).when(method == "satellite_info", 1.15).when(method == "cooccurrence", 0.8).otherwise(1.0)
    wide = F.when(F.length(context) > 50, 1.1).otherwise(1.0)
    often = F.when((source_count > 1) & (target_count > 1), 1.05).otherwise(1.0)
    return F.round(F.least(base * by * wide * often, F.lit(1.0)), 6)


def terms_product(docs: DataFrame, first: str, second: str, rel: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, source, target, rel: every term of one category with every one of another, within a document.

    Categories are short fixed lists, so a document makes a bounded number of pairs.
    """
    of = lambda c: F.transform(F.filter(F.col("terms"), lambda x: x["category"] == c), lambda x: x["term"])
    t = docs.select(key, technical_terms(F.col(text)).alias("terms")).select(key, of(first).alias("a"), of(second).alias("b"))
    return t.select(key, F.explode("a").alias("source"), "b").select(key, "source", F.explode("b").alias("target"), F.lit(rel).alias("rel"))


def resolved(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with the id of the first entity (id, name, aliases) whose name or alias equals theirs in any case; null if none."""
    a = known.select("id", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), lambda x: F.lower(x)))).alias("__alias"))
    first = a.groupBy("__alias").agg(F.min("id").alias("id"))
    return names.withColumn("__alias", F.lower(name)).join(first, "__alias", "left").drop("__alias")


def table_pairs(cells: DataFrame, kinds: dict[int, str]) -> DataFrame:
    """table, row, source, src_type, target, dst_type: ordered pairs of cells of a row whose columns have a type.

    ``cells`` has table, row and values (an array); ``kinds`` gives a column's type by its number.
    """
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    typed = F.filter(F.transform("values", lambda v, i: F.struct(i.alias("i"), F.try_element_at(kind, i).alias("kind"), v.alias("v"))), lambda x: x["kind"].isNotNull())
    t = cells.select("table", "row", typed.alias("c"))
    t = t.select("table", "row", F.explode("c").alias("a"), "c").select("table", "row", "a", F.explode("c").alias("b")).where("a.i <> b.i")
    return t.select("table", "row", F.col("a.v").alias("source"), F.col("a.kind").alias("src_type"), F.col("b.v").alias("target"), F.col("b.kind").alias("dst_type"))


def header_kinds(headers: list[str]) -> dict[int, str]:
    """The entity type that each header names, by column."""
    return {i: k for i, h in enumerate(headers) for k in fixed.ENTITY_PATTERNS if k in h.lower()}


def build_graph(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes: id, name, type, aliases, n_docs; edges: src, dst, rel, n_docs) of all documents, as lazy plans.

    A node is a name in any case and a type; an edge joins nodes whose relation a pattern or a co-occurrence gives.
    """
    e = entities(pattern_mentions(docs, key, text), key)
    node_id = lambda name, kind: F.concat(F.lower(name), F.lit(":"), kind)
    nodes = e.groupBy("lname", "type").agg(F.min("name").alias("name"), F.countDistinct(key).alias("n_docs"))
    nodes = nodes.select(node_id(F.col("name"), F.col("type")).alias("id"), "name", "type", aliases(F.col("name"), F.col("type")).alias("aliases"), "n_docs")
    r = validated(pattern_relations(docs, key, text)).select(key, "source", "src_type", "target", "dst_type", "rel")
    c = cooccurring(pattern_mentions(docs, key, text), key).select(key, "source", "src_type", "target", "dst_type", "rel")
    edges = r.unionByName(c).select(key, node_id(F.col("source"), F.col("src_type")).alias("src"), node_id(F.col("target"), F.col("dst_type")).alias("dst"), "rel")
    ids = nodes.select("id")
    edges = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, edges.groupBy("src", "dst", "rel").agg(F.countDistinct(key).alias("n_docs"))


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
