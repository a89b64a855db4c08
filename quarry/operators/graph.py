"""A labelled property graph in two DataFrames: nodes (id, name, type, confidence) and edges (src, dst, rel)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.staging import new_path, ship, staged
from quarry.sources.tables import load


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers, customers and parts as nodes."""
    spec = (("region", "r"), ("nation", "n"), ("supplier", "s"), ("customer", "c"), ("part", "p"))
    key = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey"}
    parts = [load(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(key[t]).cast("string")).alias("id"), F.col(f"{p}_name").alias("name"), F.lit(t).alias("type"), (1 - (F.col(key[t]) % 10) / 20.0).alias("confidence")) for t, p in spec]
    return reduce(DataFrame.unionByName, parts)


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """located_in edges of nations and suppliers."""
    n, s = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    e = lambda df, p, k, q, j: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("src"), F.concat(F.lit(q), F.col(j).cast("string")).alias("dst"), F.lit("located_in").alias("rel"))
    return e(n, "n", "n_nationkey", "r", "n_regionkey").unionByName(e(s, "s", "s_suppkey", "n", "s_nationkey"))


def edges(spark: SparkSession, sf_dir: str, touching: str | None = None) -> DataFrame:
    """All edges; with ``touching``, those of the relations that have ends of this node type: no other edge meets such a node."""
    c, l, o = (load(spark, sf_dir, t) for t in ("customer", "lineitem", "orders"))
    at = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("located_in").alias("rel"))
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")
    sup = l.select("l_suppkey", "l_partkey").distinct().select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), part, F.lit("supplies").alias("rel"))
    ordered = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct().select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), part, F.lit("ordered").alias("rel"))
    ends = ((geo_edges(spark, sf_dir), ("region", "nation", "supplier")), (at, ("customer", "nation")), (sup, ("supplier", "part")), (ordered, ("customer", "part")))
    return reduce(DataFrame.unionByName, (e for e, types in ends if touching in (None, *types)))


def an_edge_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among which every node that has any has one.

    Nations, suppliers and customers have their place; a part has one of its suppliers. What
    customers ordered leads to no other node: its ends are customers and parts of the same lines.
    """
    l = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    part = l.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("supplies").alias("rel"))
    c = load(spark, sf_dir, "customer")
    at = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("located_in").alias("rel"))
    return geo_edges(spark, sf_dir).unionByName(at).unionByName(part)


def both_ways(e: DataFrame) -> DataFrame:
    """Each edge in its two orientations: src, dst, rel. A union, so that joins stay equi-joins."""
    return e.select("src", "dst", "rel").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"))


def neighbours(e: DataFrame, n: DataFrame, of: str, direction: str = "both") -> DataFrame:
    """id, name, type, rel of the nodes next to ``of``."""
    o = {"out": e, "in": e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"), "both": both_ways(e)}[direction]
    return o.where(F.col("src") == of).select(F.col("dst").alias("id"), "rel").join(n, "id").select("id", "name", "type", "rel")


def _grown(step: DataFrame, start: str, depth: int, toward: DataFrame | None = None) -> list[DataFrame]:
    """The levels of node-simple paths from ``start``: node, path and depth, each level staged and read for the next one.

    Paths of the last level end in ``toward`` (column node), if given.
    """
    spark = step.sparkSession
    levels = [staged(spark.createDataFrame([(start, [start], 0)], "node string, path array<string>, depth int"), "level")]
    for d in range(1, depth + 1):
        on = step if d < depth or toward is None else step.join(toward, step["next"] == toward["node"], "left_semi")
        new = levels[-1].join(on, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("next")))
        levels.append(staged(new.select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.lit(d).alias("depth")), "level"))
    return levels


def _steps(e: DataFrame) -> DataFrame:
    """The undirected steps (src, next) of a graph, made once and staged."""
    return staged(both_ways(e).select("src", F.col("dst").alias("next")).distinct(), "steps")


def trails(e: DataFrame, start: str, depth: int) -> DataFrame:
    """node, path (array), depth: node-simple undirected paths from ``start``, level by level; the levels are staged."""
    return reduce(DataFrame.unionByName, _grown(_steps(e), start, depth))


def paths(e: DataFrame, start: str, end: str, longest: int = 5, limit: int = 10, shortest: int = 1, types: list[str] | None = None) -> DataFrame:
    """Node-simple paths of ``shortest`` to ``longest`` steps, over relations of ``types`` if given; short ones first.

    Grown from both ends, as far as the middle: a path of n steps is ceil(n / 2) steps from the
    start that meet floor(n / 2) from the end, and no level is made or read twice.
    """
    step = _steps(e if types is None else e.where(F.col("rel").isin(*types)))
    back = _grown(step, end, longest // 2)
    # the last forward level of an odd length only meets the last backward one
    forth = _grown(step, start, longest - longest // 2, back[-1].select("node").distinct() if longest % 2 else None)
    f, b = (reduce(DataFrame.unionByName, x) for x in (forth, back))
    b = b.select("node", F.slice(F.reverse("path"), 2, F.greatest("depth", F.lit(1))).alias("rest"), F.col("depth").alias("left"))
    b = b.withColumn("rest", F.when(F.col("left") > 0, F.col("rest")).otherwise(F.array().cast("array<string>")))
    met = f.join(b, "node").where((F.col("depth") - F.col("left")).isin(0, 1) & ~F.arrays_overlap("path", "rest"))
    length = F.col("depth") + F.col("left")
    return met.where(length.between(shortest, longest)).select(F.array_join(F.concat("path", "rest"), ">").alias("path"), length.alias("length")).orderBy("length", "path").limit(limit)


def traversal(e: DataFrame, n: DataFrame, start: str, depth: int = 3, types: list[str] | None = None, limit: int = 50) -> DataFrame:
    """id, name, type, distance, path of every trail from ``start``, by distance and name; ``types`` restricts where trails may end."""
    t = trails(e, start, depth).where("depth > 0").join(n, F.col("node") == n["id"])
    t = t if types is None else t.where(F.col("type").isin(*types))
    return t.select("id", "name", "type", F.col("depth").alias("distance"), F.array_join("path", ">").alias("path")).distinct().orderBy("distance", "name", "path").limit(limit)


def within(e: DataFrame, start: str, radius: int) -> DataFrame:
    """node, distance: nodes at most ``radius`` away.

    Breadth first: each level holds only nodes not seen before, and is staged, so that it is made
    once and what was seen is read as files; it ends early where nothing new is found.
    """
    spark, step = e.sparkSession, _steps(e)
    level = spark.createDataFrame([(start, 0)], "node string, distance int")
    schema, at = level.schema, []
    for d in range(radius + 1):
        if d:
            new = level.join(step, F.col("node") == F.col("src")).select(F.col("next").alias("node")).distinct()
            level = new.join(spark.read.schema(schema).parquet(*at).select("node"), "node", "left_anti").withColumn("distance", F.lit(d))
        at.append(new_path(spark, "level"))
        level.write.parquet(at[-1])
        level = spark.read.schema(schema).parquet(at[-1])
        if level.isEmpty():
            break
    return spark.read.schema(schema).parquet(*at)


def induced(e: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (column node)."""
    return e.join(ids, e["src"] == ids["node"], "left_semi").join(ids, e["dst"] == ids["node"], "left_semi")


def similar_by_neighbours(e: DataFrame, n: DataFrame, of: str) -> DataFrame:
    """id, shared, similarity: Jaccard of neighbourhoods among nodes of the same type, common neighbours reached by the same relation.

    The neighbours of the anchor's type are made once and staged; only nodes that share one with the anchor are counted.
    """
    kind = n.where(F.col("id") == of).select(F.col("type").alias("t"))
    same = n.join(F.broadcast(kind), n["type"] == F.col("t")).select(F.col("id").alias("src"))
    b = staged(both_ways(e).join(same, "src", "left_semi").distinct(), "neighbours")
    mine = b.where(F.col("src") == of).select("dst", "rel")
    near = b.where(F.col("src") != of).join(mine, ["dst", "rel"], "left_semi").groupBy("src").agg(F.countDistinct("dst").alias("shared"))
    degree = b.groupBy("src").agg(F.countDistinct("dst").alias("deg"))
    d0 = mine.agg(F.countDistinct("dst").alias("d0"))
    s = near.join(degree, "src").join(F.broadcast(d0))
    return s.select(F.col("src").alias("id"), "shared", (F.col("shared") / (F.col("deg") + F.col("d0") - F.col("shared"))).alias("similarity"))


def degrees(e: DataFrame, n: DataFrame) -> DataFrame:
    """id, degree; isolated nodes have 0."""
    d = both_ways(e).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return n.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def orphans(e: DataFrame, n: DataFrame) -> DataFrame:
    return n.join(both_ways(e).select(F.col("src").alias("id")), "id", "left_anti")


def consistency(e: DataFrame, n: DataFrame) -> DataFrame:
    """One row: nodes, orphans, repeated names, and a score of 1 less issues per node."""
    repeated = n.groupBy("name").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("repeated"))
    lone = orphans(e, n).agg(F.count(F.lit(1)).alias("orphans"))
    total = n.agg(F.count(F.lit(1)).alias("total"))
    one = total.join(F.broadcast(lone)).join(F.broadcast(repeated))
    return one.withColumn("score", F.greatest(F.lit(0.0), 1 - (F.col("orphans") + F.col("repeated")) / F.greatest(F.col("total"), F.lit(1))))


# ---- structure of the whole graph


def components(e: DataFrame, n: DataFrame) -> DataFrame:
    """id, component: the smallest id of each node's connected component, for all nodes of ``n``.

    Stars of large and of small neighbours in turn: each round joins nothing, but hands every
    node's smallest neighbour to its other ones, so labels spread over twice the distance. The
    edges of a round are staged, and rounds end once they don't change.
    """
    edges = both_ways(e).where("src > dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    edges, before = staged(edges, "edges"), None
    while True:
        both = edges.union(edges.select("b", "a"))
        # larger neighbours get the smallest neighbour or the node itself
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # a node and its smaller neighbours all get the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        edges = staged(small.where("a > b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # stars now: every node but the smallest has one edge, to it
    return n.select("id").join(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Members' edges of a group that counts triangles, and entries of the lists that it meets.
MEMBERS, ENTRIES = 1 << 18, 1 << 21


def _counted(members: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """id, triangles from members a with their ends and lists of the ends of b: a, b and c count for every a -> b -> c with a -> c."""
    flat = np.concatenate([*members["ends"], *lists["ends"]]) if len(members) and len(lists) else np.zeros(0, np.int64)
    ids, code = np.unique(np.concatenate([members["a"], lists["b"], flat]).astype(np.int64), return_inverse=True)
    if not len(flat):
        return pd.DataFrame({"id": [], "triangles": []}, dtype=np.int64)
    m, k = len(members), len(lists)
    a, b, ends = code[:m], code[m : m + k], code[m + k :]
    size = np.array([len(x) for x in [*members["ends"], *lists["ends"]]])
    start = np.cumsum(size) - size
    at = np.full(len(ids), -1)
    at[b] = np.arange(m, m + k)
    total, mine = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    for i in range(m):
        out = ends[start[i] : start[i] + size[i]]
        mine[out] = True
        has = out[at[out] >= 0]
        # the lists of all ends one after the other, in parts of bounded size
        n = size[at[has]]
        for part in np.split(np.arange(len(has)), np.searchsorted(np.cumsum(n), np.arange(ENTRIES, int(n.sum()), ENTRIES))):
            row, lens = at[has[part]], n[part]
            seg = ends[np.repeat(start[row] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]
            hit = mine[seg]
            by = np.bincount(np.repeat(np.arange(len(part)), lens)[hit], minlength=len(part))
            total[has[part]] += by
            total[a[i]] += by.sum()
            total += np.bincount(seg[hit], minlength=len(ids)) if hit.sum() > len(ids) // 8 else 0
            if hit.sum() <= len(ids) // 8:
                np.add.at(total, seg[hit], 1)
        mine[out] = False
    found = np.flatnonzero(total)
    return pd.DataFrame({"id": ids[found], "triangles": total[found]})


def triangles(e: DataFrame) -> DataFrame:
    """id, degree, triangles of every node with an edge, relations and directions aside.

    Each edge points to its end of higher degree, so no node has many edges that leave it, hubs
    least of all. No pair of edges becomes a row: nodes with the same highest end make a group
    (split where it is large), to which the list of each node that they point to is sent once,
    and the lists are intersected there. So a dense part of the graph costs its edges.
    """
    spark = e.sparkSession
    ship(spark)
    u = staged(both_ways(e).where("src < dst").select("src", "dst").distinct(), "edges")
    degree = u.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    degree = staged(degree.withColumn("n", F.monotonically_increasing_id()), "degrees")
    d = lambda c: degree.select(F.col("id").alias(c), F.struct("degree", "n").alias(f"o_{c}"))
    x = u.join(d("src"), "src").join(d("dst"), "dst").select(F.least("o_src", "o_dst").alias("low"), F.greatest("o_src", "o_dst").alias("high"))
    out = x.groupBy(F.col("low.n").alias("a")).agg(F.collect_list("high.n").alias("ends"), F.max("high").alias("top"))
    out = staged(out.select("a", "ends", F.col("top.n").alias("top")), "oriented")
    # groups by the highest end, in parts of at most MEMBERS edges or one node
    parts = out.groupBy("top").agg(F.ceil(F.sum(F.size("ends")) / MEMBERS).alias("parts"))
    members = staged(out.join(parts, "top").select("top", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), "a", "ends"), "members")
    met = members.select("top", "part", "a", "ends").repartition("top", "part").select("top", "part", F.explode("ends").alias("b")).distinct()
    lists = staged(met.join(out.select(F.col("a").alias("b"), "ends"), "b"), "lists")
    # a group's lists in slices of about ENTRIES entries; its members go to each of them
    slices = lists.groupBy("top", "part").agg(F.ceil(F.sum(F.size("ends")) / ENTRIES).alias("slices"))
    l = lists.join(slices, ["top", "part"]).withColumn("slice", F.pmod(F.xxhash64("b", F.lit(7)), F.col("slices")))
    m = members.join(slices, ["top", "part"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    key = ["top", "part", "slice"]
    each = m.select(*key, "a", "ends").groupBy(*key).cogroup(l.select(*key, "b", "ends").groupBy(*key)).applyInPandas(_counted, "id long, triangles long")
    each = each.groupBy(F.col("id").alias("n")).agg(F.sum("triangles").alias("triangles"))
    return degree.join(each, "n", "left").select("id", "degree", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def clustering(e: DataFrame, n: DataFrame) -> DataFrame:
    """id, coefficient: the share of pairs of a node's neighbours that are joined; 0 for nodes with fewer than two."""
    return coefficients(triangles(e), n)


def coefficients(t: DataFrame, n: DataFrame) -> DataFrame:
    """id, coefficient of every node of ``n``, from the degrees and triangles ``t`` of nodes."""
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    t = t.select("id", F.when(F.col("degree") > 1, F.col("triangles") / pairs).otherwise(0.0).alias("coefficient"))
    return n.select("id").join(t, "id", "left").select("id", F.coalesce("coefficient", F.lit(0.0)).alias("coefficient"))


def density(e: DataFrame, n: DataFrame) -> DataFrame:
    """One row: nodes, edges (different pairs of different nodes) and their share of all pairs."""
    nodes = n.agg(F.countDistinct("id").alias("nodes"))
    edges = both_ways(e).where("src < dst").select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(F.broadcast(edges)).select("nodes", "edges", F.coalesce(F.try_divide(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)).alias("density"))
