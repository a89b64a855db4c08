"""Queries whose SQL in the catalogue does less than the whole job, against the whole job."""

import re
from collections import defaultdict

import duckdb

from quarry.functions import fixed
from quarry.operators import extraction, vector
from quarry.plans import catalogue, processing

DIR = "/root/testdata/sf0.001"


def test_data_chain_has_every_part(spark):
    sql = "SELECT p_name, s_name, n_name, r_name FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    c = duckdb.connect()
    for n in ("part", "lineitem", "supplier", "nation", "region"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{DIR}/{n}.parquet'")
    got = catalogue.data_chain_3hop(spark, DIR)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(sql).fetchall())


def by_brute_force(docs):
    out = defaultdict(list)
    for doc_id, text in docs:
        m = list(re.finditer("[A-Z][a-z]{3,}", text or ""))
        for i, a in enumerate(m):
            for b in m[i + 1 :]:
                if b.start() - a.end() > 200:
                    break
                if a[0] != b[0]:
                    out[a[0], b[0]].append(doc_id)
    return sorted((*k, len(v), len(set(v))) for k, v in out.items())


def test_cooccurrence_counts_characters(spark, tmp_path):
    docs = [(1, "Anna" + "x" * 200 + "Berta"), (2, "Anna" + "x" * 201 + "Berta"), (3, "\U0001d11e" * 150 + "Carla" + "A " * 60 + "\U0001d11eDoris Carla"), (4, None), (5, ""), (6, "Anna. Berta"), (6, "Carla Anna")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, catalogue.cooccurrence(spark, str(tmp_path)).collect())) == by_brute_force(docs)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    assert sorted(map(tuple, catalogue.cooccurrence(spark, DIR).collect())) == by_brute_force(docs)


def test_pairwise_distances_cover_all_pairs(spark):
    d = "1 - coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0)"
    sql = f"SELECT {{0}} AS label, round(avg({d}), 6), round(stddev_pop({d}), 6), count(*) FROM '{DIR}/embeddings.parquet' a JOIN '{DIR}/embeddings.parquet' b ON a.vec_id < b.vec_id {{1}} GROUP BY 1"
    want = duckdb.sql(sql.format("NULL", "")).fetchall() + duckdb.sql(sql.format("a.label", "AND a.label = b.label")).fetchall()
    got = [tuple(r) for r in catalogue.pairwise_distance_stats(spark, DIR).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_pairwise_distances_of_zero_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [2.0, 0.0], 2), (3, None, None), (4, [0.0, 1.0, 0.0], 3)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    # of ten pairs only (0, 2) has a cosine, of 1
    assert sorted(map(tuple, vector.pairwise_distances(e, "label").collect()), key=str) == [(1, 1.0, 0.0, 1), (None, 0.9, 0.3, 10)]
    assert vector.pairwise_distances(e.where("vec_id = 0"), "label").count() == 0


def test_crawl_reaches_every_level_and_relative_links(spark, tmp_path):
    at = "http://a.org/d/"
    pages = [(i, f"{at}{i}", f'<a href="{(at, "", "/d/", "../d/")[i % 4]}{i + 1}"> <a href="{at}0"> <a href="http://[bad">') for i in range(10, 30)] + [(99, "http://z.org/", '<a href="more">')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {f"{at}{i}": i - 10 for i in range(10, 31)} | {f"{at}0": 1, "http://[bad": 1}
    got = [tuple(r) for r in catalogue.crawl_reach(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_question_pairs_of_whole_conversations(spark):
    """All turns and whole texts, against Python's expressions."""
    turns = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{DIR}/conversations.parquet' ORDER BY ALL").fetchall()
    said = defaultdict(list)
    for conv, _, role, text in turns:
        said[conv].append(("Q: " if role == "user" else "A: ") + text)
    want = []
    for conv, lines in said.items():
        t = "\n".join(lines)
        pairs = [(m[1].strip(" \t\n\x0b\f\r"), m[2].strip(" \t\n\x0b\f\r")) for m in re.finditer(fixed.QA, t, re.ASCII)]
        pairs += [p for m in re.finditer(fixed.FAQ, t, re.ASCII) if all(p := (m[2].strip(" \t\n\x0b\f\r"), m[3].strip(" \t\n\x0b\f\r")))]
        want += [(conv, i, *p) for i, p in enumerate(pairs)]
    assert sorted(map(tuple, processing.question_pairs_of_turns(spark, DIR).collect())) == sorted(want) and want


def test_relation_contexts(spark):
    text = "INSAT-3D carries imager over Arabian Sea, resolution: 4 km. VHRR measures SST with accuracy: high since 2013 at about 10 km. INSAT-3D observes India, coverage: national"
    rows = [(1, text), (2, None), (3, "")]
    got = {(r["rel"], r["source"], r["target"]): r for r in extraction.pattern_relations(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = got["has_instrument", "INSAT-3D", "imager"]
    around = re.sub(r"\s+", " ", text[: len("INSAT-3D carries imager") + 100]).strip()
    every = lambda ps, g: [m[g] for p in ps for m in re.finditer(p, around, re.I)]
    assert first["context"] == around and first["spatial"] == every(fixed.SPATIAL, 1) and first["temporal"] == every(fixed.TEMPORAL, 1)
    assert first["quantitative"] == [f"{a} {b}" for a, b in zip(every(fixed.QUANTITATIVE, 1), every(fixed.QUANTITATIVE, 2))] and first["stated"] == {}
    assert next(r["stated"] for k, r in got.items() if k[0] == "measures") == {"measurement_accuracy": "high"}
    seen = next(r["stated"] for k, r in got.items() if k[0] == "observes")
    assert seen == {"coverage_area": "national", "spatial_resolution": "4"}


def test_matches_of_a_text_are_placed_in_its_own_row(spark):
    """One row per text before the matches: no pattern makes a copy of it."""
    docs = spark.createDataFrame([(1, "INSAT-3D carries VHRR over India")], "doc_id long, text string")
    plan = extraction.pattern_mentions(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1


def test_cooccurring_relations_by_brute_force(spark):
    docs = spark.createDataFrame([(1, "INSAT-3D and VHRR see SST. " + "x" * 210 + " Kalpana-1 carries CCD over India"), (2, None)], "doc_id long, text string")
    m = extraction.pattern_mentions(docs)
    rows = m.collect()
    first = {}
    for i, (rel, sources, targets) in enumerate(fixed.RELATIONS):
        for a in sources:
            for b in targets:
                first.setdefault((a, b), rel)
    want = {}
    order = lambda r: (r["start"], r["end"], r["type"], r["pattern"])
    for a in rows:
        for b in rows:
            gap = b["start"] - a["end"]
            if order(a) < order(b) and -200 < gap <= 200 and a["name"] != b["name"] and (a["type"], b["type"]) in first:
                k = (a["name"], b["name"], first[a["type"], b["type"]], a["type"], b["type"])
                want[k] = min(gap, want.get(k, 999))
    got = {(r["source"], r["target"], r["rel"], r["src_type"], r["dst_type"]): r["distance"] for r in extraction.cooccurring(m).collect()}
    assert got == want and want
