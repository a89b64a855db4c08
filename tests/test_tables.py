"""Keyed tables, counters of a run, sketches and variant properties."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.functions import properties as P
from quarry.functions import sketches as K
from quarry.operators.counted import Counters
from quarry.plans import processing, structure
from quarry.sources import keyed_table as T

DIR = "/root/testdata/sf0.001"


def files(path):
    return {f for folder, _, names in os.walk(f"{path}/data") for n in names if n.endswith(".parquet") for f in [os.path.join(folder, n)]}


def used(spark, path):
    return set(T._manifest(spark, path)["places"].items())


def test_a_merge_rewrites_only_what_it_hits(spark, tmp_path):
    path = str(tmp_path / "t")
    T.create(spark.range(1000).select("id", F.lit("a").alias("x"), F.col("id").alias("y")), path, "id", 16)
    before, places = files(path), used(spark, path)
    hit = T.merge(spark.createDataFrame([(5, "b"), (5000, "c")], "id long, x string"), path)
    assert 1 <= len(hit) <= 2 and before <= files(path)
    assert {p for p in places if int(p[0]) not in hit} <= used(spark, path) and not {p for p in places if int(p[0]) in hit} & used(spark, path)
    rows = {r["id"]: (r["x"], r["y"]) for r in T.read(spark, path).collect()}
    assert len(rows) == 1001 and rows[5] == ("b", 5) and rows[5000] == ("c", None) and rows[6] == ("a", 6)
    T.merge(spark.createDataFrame([(6, None), (6, "z"), (7, "q")], "id long, x string"), path, [F.length(F.coalesce("x", F.lit("")))])
    assert {r["id"]: r["x"] for r in T.read(spark, path).where("id IN (6, 7)").collect()} == {6: "z", 7: "q"}
    T.merge(spark.createDataFrame([(6,), (77777,)], "id long"), path, delete=F.lit(True))
    assert T.read(spark, path).count() == 1000 and T.read(spark, path).where("id = 6").count() == 0
    assert T.merge(spark.createDataFrame([], "id long, x string"), path) == [] and T.read(spark, path).count() == 1000


def test_a_failed_merge_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    T.create(spark.range(50).select("id", F.lit("a").alias("x")), path, "id", 4)
    before = used(spark, path)
    bad = spark.range(9).select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise("b").alias("x"))
    with pytest.raises(Exception, match="no"):
        T.merge(bad, path)
    assert used(spark, path) == before and T.read(spark, path).where("x = 'a'").count() == 50
    # two merges from one version: the second is refused
    m = T._manifest(spark, path)
    T._publish(spark, path, m | {"version": 1})
    with pytest.raises(RuntimeError, match="another merge"):
        T._publish(spark, path, m | {"version": 1})


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    T.create(spark.createDataFrame([], "id long, x string"), path, "id", 4)
    assert T.read(spark, path).count() == 0
    T.merge(spark.createDataFrame([(1, "a")], "id long, x string"), path)
    assert [tuple(r) for r in T.read(spark, path).collect()] == [(1, "a")]


def test_counters_are_those_of_the_pass(spark, tmp_path):
    t = processing.items(spark, DIR)
    got = structure.processed(t, str(tmp_path / "out"))
    v = processing.scored(processing.normalised(t.where(processing.valid(t))))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert got["seen"] == t.count() and got["valid"] == v.count() and got["kept"] == out.count()
    assert got["valid.with_terms"] == v.where("term_kinds > 0").count() and got["kept.characters"] == out.agg(F.sum(F.length("main_content"))).first()[0]


def test_counting_adds_no_scan(spark):
    c = Counters()
    df = c.watch(c.watch(spark.read.parquet(f"{DIR}/events.parquet"), "all").where("value > 1"), "some", most=F.max("value"))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = df.collect()
    assert c.values() == {"all": spark.read.parquet(f"{DIR}/events.parquet").count(), "some": len(rows), "some.most": max(r["value"] for r in rows)}


def test_merged_sketches_hold_their_bounds(spark):
    e = spark.range(200_000).select((F.col("id") % 60_007).alias("user"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double").alias("x"), F.timestamp_add("HOUR", F.col("id") % 720, F.lit("2024-01-01").cast("timestamp")).alias("ts"))
    days = K.by_day(e, "ts", "user", "x")
    assert days.count() == 30
    m = K.merged(days).select("n", K.distinct_count().alias("users"), *(K.quantile(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99)))).first()
    assert m["n"] == 200_000 and abs(m["users"] - 60_007) <= 3 * 0.0065 * 60_007
    ranks = e.agg(*(F.avg((F.col("x") <= m[f"q{i}"]).cast("int")) for i in range(3))).first()
    assert all(abs(r - q) <= 0.01 for r, q in zip(ranks, (0.1, 0.5, 0.99), strict=True))


def test_properties(spark):
    rows = [(1, '{"a": 1, "b": {"c": "x"}, "d": [1, 2]}'), (2, '{"a": "no"}'), (3, "not json"), (4, None)]
    df = spark.createDataFrame(rows, "id int, p string").withColumn("v", P.parsed(F.col("p")))
    got = {r["id"]: (r["a"], r["c"], r["d"]) for r in df.select("id", P.at("v", "$.a", "int").alias("a"), P.at("v", "$.b.c", "string").alias("c"), P.at("v", "$.d[1]", "int").alias("d")).collect()}
    assert got == {1: (1, "x", 2), 2: (None, None, None), 3: (None, None, None), 4: (None, None, None)}
    assert [r["id"] for r in df.where(P.holds("v", {"$.a": 1, "$.b.c": "x"})).collect()] == [1]
    up = df.select("id", P.updated(F.col("v"), F.parse_json(F.lit('{"a": 5, "e": true}'))).alias("v"))
    got = {r["id"]: (r["a"], r["c"], r["e"]) for r in up.select("id", P.at("v", "$.a", "int").alias("a"), P.at("v", "$.b.c", "string").alias("c"), P.at("v", "$.e", "boolean").alias("e")).collect()}
    assert got == {1: (5, "x", True), 2: (5, None, True), 3: (5, None, True), 4: (5, None, True)}
