"""Operators of the engine on small fixtures: mutations, pages, extraction, vectors, crawls, state and streams."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import text as X
from quarry.operators import extraction as E
from quarry.operators import graph as G
from quarry.operators import mutation as M
from quarry.operators import pages as P
from quarry.operators import relational as R
from quarry.operators import vector as V
from quarry.plans import processing, state
from quarry.sources import vectors
from quarry.streaming import windows as S

rows = lambda df: sorted(map(tuple, df.collect()), key=str)


# ---- mutations


def test_insert_refuses_known_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c"), (None, "n")], "k int, v string")
    assert rows(M.insert(old, new, "k")) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(M.rejected(old, new, "k")) == [(2, "x"), (None, "n")]


def test_update_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    got = M.update(old, "k", 2, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), v="z").select("k", "v", F.col("updated_at").isNotNull().alias("u"))
    assert rows(got) == [(1, "a", False), (2, "z", True), (None, "c", False)]
    gone = spark.createDataFrame([(1,), (9,), (1,)], "k int")
    assert rows(M.delete(old, gone, "k")) == [(2, "b"), (None, "c")]
    assert rows(M.deletions(old, gone, "k")) == [(1, True), (9, False)]
    assert M.clear(old).count() == 0


def test_merge_nodes_is_right_biased(spark):
    old = spark.createDataFrame([("a", {"x": "1", "y": "1"}), ("b", {})], "id string, properties map<string,string>")
    new = spark.createDataFrame([("a", 2, {"x": "3"}), ("a", 1, {"x": "2", "z": "2"}), ("c", 1, {"q": None})], "id string, ord int, properties map<string,string>")
    got = {r.id: r.properties for r in M.merge_nodes(old, new, "id", "ord").collect()}
    assert got == {"a": {"x": "3", "y": "1", "z": "2"}, "b": {}, "c": {"q": None}}


def test_upsert_keeps_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "y", 2), (2, "x", 1), (3, "c", 1)], "k int, v string, o int")
    assert rows(M.upsert_last(old, new, "k", [F.col("o")]).select("k", "v")) == [(1, "a"), (2, "y"), (3, "c")]


def test_edges_need_both_ends_and_nodes_take_theirs_along(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "b", "r")], "src string, dst string, rel string")
    new = spark.createDataFrame([("a", "b", "r"), ("a", "x", "r"), ("x", "y", "r")], "src string, dst string, rel string")
    assert rows(M.create_edges(e, new, n)) == [("a", "b", "r"), ("a", "b", "r")]
    assert rows(M.dangling(new, n)) == [("a", "x", "r"), ("x", "y", "r")]
    kept, left = M.detach_delete(n, e, spark.createDataFrame([("b",)], "id string"))
    assert rows(kept) == [("a",), ("c",)] and left.count() == 0


def test_by_id_fails_on_several(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert rows(R.by_id(df, "k", 2)) == [(2, "c")] and R.by_id(df, "k", 3).count() == 0
    with pytest.raises(Exception, match="unique"):
        R.by_id(df, "k", 1).collect()


# ---- graphs


def test_breadth_first_equals_brute_force(spark):
    r = random.Random(3)
    pairs = {(f"n{r.randint(0, 30)}", f"n{r.randint(0, 30)}") for _ in range(45)}
    e = spark.createDataFrame([(a, b, "r") for a, b in pairs], "src string, dst string, rel string")
    near = {"n1": 0}
    for d in range(1, 4):
        for a, b in pairs | {(b, a) for a, b in pairs}:
            if near.get(a) == d - 1 and b not in near:
                near[b] = d
    assert dict(rows(G.within(e, "n1", 3).select("node", "distance"))) == near


# ---- pages


PAGE = """<!DOCTYPE html><html><head><title> T &amp; U </title><meta name="Description" content="no"><meta name="description" content=" d "><meta name="date" content="1"><meta name="published" content="2">
<script>var x = {"a": "</p>"}; </script><style>p{}</style></head><body><nav><a href="/a" title="t">A</a><a>no</a></nav><div class="x breadcrumbs"><a href="b">B</a></div>
<h1>Head</h1><p>one<b>two</b></p><img src="i.png" width="3"><table><caption>Specs</caption><thead><tr><th>k</th><th>v</th></tr></thead><tbody><tr><td>size</td><td>9</td></tr></tbody></table>
<form action="/s"><input name="q" required><select name="o"><option value="1">One</option></select></form><a href="mailto:x">m</a><a href="//h/x">Download it</a><pre class="py">code</pre>
<h2>Next</h2><p>tail</p><!-- hidden --><footer>foot</footer></body></html>"""


def test_page_fields():
    n = H.parse(PAGE)
    assert H.title(n) == "T & U" and H.description(n) == "d" and H.metadata(n)["published_date"] == "2" and H.metadata(n)["description"] == " d "
    assert H.navigation(n) == [("A", "/a", "t")] and H.breadcrumbs(n) == [("B", "b")]
    assert H.links(n, "http://h/p/q") == ["http://h/a", "http://h/p/b", "http://h/x"]
    assert H.images(n, "http://h/p/") == [("http://h/p/i.png", "", "", "3", None)]
    assert H.tables(n) == [(["k", "v"], [["size", "9"]], "Specs")]
    assert H.forms(n) == [("/s", "get", [("q", "input", "", "", True, None), ("o", "select", "", "", False, [("1", "One")])])]
    assert H.product(n) == ("Head", {"k": "v", "size": "9"}, [("//h/x", "Download it", "")])
    assert H.documentation(n)[0][1][:2] == ("Next", 2) and H.documentation(n)[1] == [("code", "py")]
    assert "hidden" not in H.visible(n) and "onetwo" in H.visible(n) and "var x" not in H.visible(n)
    assert "foot" not in H.main_content(H.parse(PAGE)) and H.main_content(H.parse("<main>a  b</main><p>c")) == "a b"
    assert H.page_type(n, "http://h/Manual") == "documentation" and H.page_type(H.parse("<title>Frequently Asked"), "http://h/") == "faq"
    assert H.faq(H.parse('<div class="faq"><li class="question"><h3>Why?</h3><p>So.</p></li></div>')) == [("Why?", "So.")]
    assert H.satellite(H.parse("<title>S</title><body><h2>Instruments</h2><ul><li>I1</li></ul><p>launched on 12-05-2011</p>")) == ("S", "12-05-2011", ["I1"])
    for odd in (None, "", "<", "<p", "</p></p>", "<a href=x", "<div>" * 3000):
        assert isinstance(H.visible(H.parse(odd)), str)


def test_sanitise_html():
    assert H.sanitise('<p onclick="x" class="c">a<script>b</script><a href="javascript:1" title="t">c</a><img src="u"></p>') == '<p class="c">ab<a title="t">c</a><img src="u"></p>'


def test_records_of_nothing_and_nulls(spark):
    schema = "page_id long, url string, html string"
    assert P.records(spark.createDataFrame([], schema)).count() == 0
    r = P.records(spark.createDataFrame([(1, None, None), (None, "http://h/faq", PAGE)], schema)).collect()
    assert len(r) == 2 and {x.page_type for x in r} == {"general", "faq"}


def test_crawl_equals_brute_force(spark, tmp_path):
    r = random.Random(4)
    names = [f"http://s/{i}" for i in range(60)]
    out = {u: [r.choice([*names, "http://t/1", f"{u}.pdf"]) for _ in range(14)] for u in names[:50]}
    seen, queue = {names[0]}, [(names[0], 0)]
    for u, d in queue:
        fresh = 0
        for v in dict.fromkeys(out.get(u, [])):
            if v.startswith("http://s/") and not v.endswith(".pdf") and v not in seen_before(queue, d) and fresh < 4:
                fresh += 1
                if v not in seen:
                    seen.add(v)
                    queue.append((v, d + 1))
    links = spark.createDataFrame([(u, i, v) for u, vs in out.items() for i, v in enumerate(dict.fromkeys(vs))], "src string, pos int, dst string")
    pages = spark.createDataFrame([(u,) for u in names], "url string")
    n = itertools.count()

    def stage(df):
        path = f"{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    for most in (20, 1000):
        got = sorted((x.rank, x.url, x.depth) for x in P.crawl(pages, links, names[0], most, 4, stage).collect())
        assert [(u, d) for _, u, d in got] == queue[:most]


def seen_before(queue, depth):
    """Urls queued at a level of ``depth`` or above: a level is judged as a whole."""
    return {u for u, d in queue if d <= depth}


def test_fetch_retries(spark):
    def opener(url):
        if url == "gone":
            raise OSError
        return (429, "") if url == "busy" else (200, url)

    got = rows(P.fetch(spark.createDataFrame([("ok",), ("busy",), ("gone",)], "url string"), opener, 3, 0.001))
    assert got == [("busy", 429, None, 3), ("gone", 0, None, 3), ("ok", 200, "ok", 1)]


# ---- extraction


def test_negated_relations_are_left_out(spark):
    t = "INSAT-3D carries VHRR since 2010. " + "x" * 60 + " It may be that INSAT-3D carries CCD."
    got = E.pattern_relations(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")).where("rel = 'has_instrument'").collect()
    assert [(r.doc_id, r.source, r.target, list(r.temporal)[:1]) for r in got] == [(1, "INSAT-3D", "VHRR", ["2010"])]


def test_places_are_code_points(spark):
    t = "\U0001d11eé INSAT-1A, " * 300
    m = E.pattern_mentions(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("start").collect()
    assert len(m) == 300 and all(t[x.start : x.end] == "INSAT-1A" for x in m)


# ---- vectors


def test_assignment_is_the_cheapest(spark):
    import numpy as np

    r = np.random.default_rng(2)
    for n in (1, 2, 4, 6):
        c = r.integers(-9, 9, (n, n)).astype(float)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sum(c[i, j] for i, j in enumerate(V.assignment(c))) == best


def test_equal_texts_have_equal_vectors(spark):
    got = {r.i: r.embedding for r in V.embedded(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "i int, text string"), size=8).collect()}
    assert got[1] == got[2] and got[3] == got[4] == [0.0] * 8 and abs(sum(x * x for x in got[1]) - 1) < 1e-4


def test_hybrid_fuses_documents_of_one_title_and_head(spark):
    d = spark.createDataFrame([(0, "the same", "s"), (1, "the same", "s"), (2, "the other", "s")], "doc_id long, text string, source string")
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = V.hybrid(d, e, 0, "the").collect()
    assert sorted(r.doc_id for r in got) == [0, 2]
    with pytest.raises(ValueError):
        V.search(d, e, "other", 0, "the")


def test_vector_store_refuses_other_sizes(spark, tmp_path):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1])], "vec_id long, embedding array<double>")
    vectors.save(e.where("vec_id = 0"), f"{tmp_path}/v", "m", 2)
    vectors.append(e, f"{tmp_path}/v", "m", 2)
    assert vectors.load(spark, f"{tmp_path}/v").count() == 2
    with pytest.raises(Exception, match="size"):
        vectors.save(e, f"{tmp_path}/w", "m", 3)


# ---- texts


def test_chunkers(spark):
    d = spark.createDataFrame([(1, "A b. " * 300), (2, None), (3, "")], "doc_id long, text string")
    c = [r for r in processing.sentence_chunks(d).collect()]
    assert {r.doc_id for r in c} == {1} and c[0].end_sentence + 1 - c[1].start_sentence == 2
    t = "\n\n".join(" ".join(["word"] * n) for n in (5, 500, 3, 900))
    chunks = [r.text for r in processing.recursive_chunks(spark.createDataFrame([(1, t), (2, "x" * 2500), (3, None)], "doc_id long, text string")).collect()]
    assert max(map(len, chunks)) <= 1000 and sum(c.count("word") for c in chunks) >= 1408
    assert spark.range(1).select(X.stride_chunks(F.lit("abcdefghij"), 5, 2).alias("c")).first().c == ["abcde", "defgh", "ghij", "j"]
    assert spark.range(1).select(X.stride_chunks(F.lit("ab\ncdefgh"), 4, 3).alias("c")).first().c == ["ab\nc", "b\ncd", "\ncde", "cdef", "defg", "efgh", "fgh", "gh", "h"]


def test_marked_questions(spark):
    t = "Q: one? A: yes. Q: two? A: no."
    got = spark.range(1).select(processing.question_pairs(F.lit(t)).alias("x")).first().x
    assert [(p.question, p.answer) for p in got][:2] == [("one?", "yes."), ("two?", "no.")]


@pytest.mark.parametrize(("value", "said"), [("a.PDF", ""), ("a", "no extension"), ("", "no name"), ("a.exe", "type not allowed")])
def test_file_types(spark, value, said):
    assert spark.range(1).select(X.file_type_problems(F.lit(value), ("pdf",))).first()[0] == said


def test_small_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.slug(F.lit("  Über die_Öffnung -- x!"))) == "über-die_öffnung-x" and len(one(X.slug(F.lit("a" * 80)))) == 50
    assert one(X.truncate(F.lit("abcdef"), 5)) == "ab..." and one(X.extension(F.lit("a/b.TXT"))) == "txt"
    assert one(X.is_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000"))) and not one(X.is_uuid(F.lit("x")))
    assert one(X.is_email(F.lit("a@b.org"))) and not one(X.is_email(F.lit("a@b")))
    assert one(X.safe_json(F.lit("{"), "$.a")) is None and one(X.safe_json(F.lit('{"a": 1}'), "$.a")) == "1"
    assert one(X.parse_date(F.lit("x"))) is None and one(X.file_size(F.lit(0))) == "0 B"
    assert one(X.sanitise(F.lit("<b>a</b> javascript:x onclick = y"))) == "a x y"
    assert one(X.map_merge(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2)))) == {"a": 1, "b": 2}


# ---- state


def test_job_states():
    told = []
    j = state.Job({"scraping": lambda _: 1, "processing": lambda x: x + 1}, (lambda n, p: told.append((n, p)),))
    assert j.run() == "completed" and j.result == 2 and [p for _, p in told] == [0.2, 0.4, 0.6, 0.8, 1.0]
    j = state.Job({"scraping": lambda _: 1 / 0})
    assert j.run() == "failed" and "scraping" in j.error and j.progress == 0
    j = state.Job({})
    j.pause()
    assert j.run() == "paused"
    j.resume()
    assert j.status == "completed"
    with pytest.raises(ValueError):
        state.Job({"other": print})


def test_result_cache(spark):
    now, made = [0.0], []
    c = state.ResultCache(10, 2, lambda: now[0])

    def make(n):
        def f():
            made.append(n)
            return spark.range(n)

        return f

    assert c.get("q", {"a": 1, "b": 2}, make(3)).count() == 3 and c.get("q", {"b": 2, "a": 1}, make(3)).count() == 3 and made == [3]
    c.get("empty", {}, make(0))
    c.get("empty", {}, make(0))
    assert made == [3, 0, 0]
    now[0] = 11
    c.get("q", {"a": 1, "b": 2}, make(3))
    assert made == [3, 0, 0, 3]


# ---- streams


def run_stream(df, path):
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None


def test_tumbling_counts_of_a_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type").orderBy("ts")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    run_stream(S.streaming_counts(s, "ts", "1 day", "1 hour", "event_type"), tmp_path)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(F.col("start").cast("string"), "event_type", "n").collect()}
    want = {tuple(r) for r in S.tumbling(src, "ts", "1 day", "event_type").select(F.col("start").cast("string"), "event_type", "n").collect()}
    assert got and got <= want


def test_feed_of_conditions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"station":"s","at":"2024-01-01T00:00:00","current":{"temperature":"31.5 °C","humidity":"x"},"alerts":["a","b"]}\n')
    run_stream(S.conditions(S.feed(spark, f"{tmp_path}/in", S.CONDITIONS)).select("station", "temperature", "humidity", "alerts"), tmp_path)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [("s", 31.5, None, 2)]
