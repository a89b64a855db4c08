"""The learned operators against plain loops: additive model, mixtures of languages; media; and odd inputs of every operator."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, linededup, media, ngramjoin, quality, secrets, spm, urlfilter, warc

r = random.Random(21)
words = ["".join(r.choices("abcdefghijklmno", k=r.randint(2, 8))) for _ in range(200)]
prose = lambda n: " ".join(r.choices(words, k=n))


# ---- additive model


def tree(g, h, depth):
    """The best tree of ``depth`` cuts on ordered bins by trying every cut."""
    whole = sum(g) / (sum(h) + quality.RIDGE)
    best = None
    if depth and len(g) > 1:
        for at in range(1, len(g)):
            if sum(h[:at]) < 1 or sum(h[at:]) < 1:
                continue
            gain = sum(g[:at]) ** 2 / (sum(h[:at]) + quality.RIDGE) + sum(g[at:]) ** 2 / (sum(h[at:]) + quality.RIDGE)
            if best is None or gain > best[0] + 1e-12:
                best = gain, at
    if best is None or best[0] <= sum(g) ** 2 / (sum(h) + quality.RIDGE) + 1e-9:
        return [whole] * len(g)
    at = best[1]
    return tree(g[:at], h[:at], depth - 1) + tree(g[at:], h[at:], depth - 1)


def test_trees_equal_every_cut_tried():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 12):
        for _ in range(20):
            g, h = rng.normal(size=n), rng.uniform(0.5, 3, n)
            assert np.allclose(quality._step_values(g, h), tree(g.tolist(), h.tolist(), 2))


def test_boosting_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 3)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 0)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(80, 3)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = quality.Model(x, y)
    bin_of = lambda e, v: sum(v >= c for c in e)
    tables = [[0.0] * (len(e) + 1) for e in m.edges]
    z = [m.bias] * len(x)
    assert m.bias == pytest.approx(math.log((sum(y) + 1) / (len(y) - sum(y) + 1)))
    for _ in range(3):
        for f, e in enumerate(m.edges):
            g, h = [0.0] * (len(e) + 1), [0.0] * (len(e) + 1)
            for i in range(len(x)):
                p = 1 / (1 + math.exp(-z[i]))
                g[bin_of(e, x[i, f])] += y[i] - p
                h[bin_of(e, x[i, f])] += p * (1 - p)
            step = [quality.RATE * v for v in tree(g, h, 2)]
            tables[f] = [a + b for a, b in zip(tables[f], step, strict=True)]
            z = [v + step[bin_of(e, x[i, f])] for i, v in enumerate(z)]
    for a, b in zip(m.tables, tables, strict=True):
        assert np.allclose(a, b)


def test_scores_add_one_bin_of_each_table():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.Model(x, y)
    assert m.pairs and (1, 0) in m.pairs
    odd = np.concatenate((x, [[-9.0] * 4, [9.0] * 4, [m.edges[f][0] for f in range(4)]]))
    for row, got in zip(odd, m.score(odd), strict=True):
        z = m.bias + sum(t[sum(row[f] >= c for c in m.edges[f])] for f, t in enumerate(m.tables))
        z += sum(t[sum(row[f] >= c for c in m.coarse[f]), sum(row[j] >= c for c in m.coarse[j])] for (f, j), t in m.pairs.items())
        assert got == pytest.approx(1 / (1 + math.exp(-z)))
    assert ((m.score(x) > 0.5) == (y > 0)).mean() > 0.9


# ---- mixtures of languages


def test_mixtures_equal_plain_loops():
    rng = np.random.default_rng(4)
    m = langid.Model(["aa", "bb", "cc"], rng.integers(0, 50, (3, langid.BUCKETS)).astype(float))
    texts = [prose(5).encode(), prose(200).encode(), b"x", prose(60).encode() + b" " + prose(60).upper().encode()]
    pi, kept = m.proportions(texts)
    for t, got, size in zip(texts, pi, kept, strict=True):
        data, (n,) = langid._units([t])
        codes = langid.codes(data)
        units = [[math.fsum(float(m.table[c, k]) for c in codes[u * langid.UNIT : (u + 1) * langid.UNIT]) for k in range(3)] for u in range(n)]
        like = [[math.exp(v - max(u)) for v in u] for u in units]

        def fit(p, rounds, like=like, n=n):
            for _ in range(rounds):
                new = [0.0] * 3
                for u in like:
                    s = sum(a * b for a, b in zip(u, p, strict=True))
                    new = [x + a * b / max(s, 1e-300) / n for x, a, b in zip(new, u, p, strict=True)]
                p = new
            return p, sum(math.log(max(sum(a * b for a, b in zip(u, p, strict=True)), 1e-300)) for u in like)

        full, _ = fit([1 / 3] * 3, langid.ROUNDS)
        order = sorted(range(3), key=lambda k: (-full[k], k))
        best = None
        for k in range(1, 4):
            start = [max(full[i], 1e-6) if i in order[:k] else 0.0 for i in range(3)]
            p, value = fit([v / sum(start) for v in start], langid.ROUNDS // 2 if 1 < k < 3 else 0)
            value -= (k - 1) * 0.5 * math.log(max(n, 2)) + (k - 1)
            if best is None or value > best[0] + 1e-9:
                best = value, p, k
        assert size == best[2] and np.allclose(got, best[1], atol=1e-4)


# ---- media


def test_media_checks_and_damage(spark):
    data = ["", "a", "é" * 1000, "x" * 576]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(data)] + [(None, None), (2, data[2])], "doc_id long, text string")
    rows = media.from_media(media.to_media(docs)).collect()
    assert len(rows) == 6
    for x in rows:
        b = ("" if x.doc_id is None else data[x.doc_id]).encode()
        payload = b + b"\xff" * (-len(b) % 576 or (576 if not b else 0))
        assert x.read.payload_sha256 == hashlib.sha256(payload).hexdigest() and x.read.tail_crc32 == zlib.crc32(payload[-32:])


def test_cosine_hash_is_that_of_the_transform():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (24, 24)).astype(np.uint8)
    assert media.cosine_hash(image) == media.cosine_hash(image.copy())
    brighter = np.clip(image.astype(int) // 2 + 20, 0, 255).astype(np.uint8)
    a, b = (int(media.cosine_hash(x), 16) for x in (image, brighter))
    other = int(media.cosine_hash(rng.integers(0, 256, (24, 24)).astype(np.uint8)), 16)
    assert (a ^ b).bit_count() <= 6 < (a ^ other).bit_count()


# ---- odd inputs


@pytest.fixture(scope="module")
def odd(spark):
    t = [None, "", " ", prose(40), prose(40), "word " * 20_000, "\n" * 5000, prose(30) + "\n" + prose(30), "é日\U0001d11e" * 50]
    rows = [(i, x) for i, x in enumerate(t)] + [(3, t[3]), (None, t[3]), (None, None)]
    names = ("n_hit", "score", "hits", "secrets", "language", "token_ids", "cid", "n", "comp", "gone", "done", "key", "h", "p")
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(7).alias(c) for c in names)).repartition(3)


def equal_rows_equal_results(df, *values):
    assert df.groupBy("doc_id", "text").agg(F.countDistinct(F.struct(*values)).alias("k")).where("k > 1").count() == 0


def test_line_dedup_of_odd_inputs(odd):
    got = linededup.dedup_lines(odd, counts=("n_lines", "n_removed"))
    assert got.columns == [*odd.columns, "n_lines", "n_removed"] and got.count() == odd.count()
    assert got.where("cid <> 7 OR gone <> 7").count() == 0
    empty = got.where("doc_id = 6").first()
    assert (empty.n_lines, empty.n_removed, empty.text) == (5001, 0, "\n" * 5000)


def test_line_dedup_of_a_hundred_thousand_lines(spark):
    n = 100_000
    lines = [f"w{i} x{i} y{i} z{i}" if i % 2 else "the same line" for i in range(n)]
    got = linededup.dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"), counts=("n_lines", "n_removed")).first()
    assert (got.n_lines, got.n_removed) == (n, n // 2 - 1)
    assert got.text.split("\n")[:3] == lines[:2] + lines[3:4]


def test_line_dedup_splits_at_ascii_white_space_only(spark):
    rows = [(1, "a b\tc\x0bd\x0ce"), (2, "a b c d e"), (3, "a b c d e"), (4, " ")]
    got = {x.doc_id: x.text for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1], 4: " "}


def test_components_of_odd_inputs(odd):
    got = ngramjoin.similar_components(odd, 3, 90, 100).collect()
    assert len(got) == 12
    by = [(x.doc_id, x.component_id) for x in got if x.doc_id == 3]
    assert by == [(3, 3), (3, 3)]


def test_scores_of_odd_inputs(odd):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = quality.score(odd, quality.train(odd.withColumnRenamed("doc_id", "doc_id"), labels))
    assert set(got.columns) == set(odd.columns) and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    equal_rows_equal_results(got, "score")
    ones = quality.train(odd, labels.where("quality = 1"))
    assert {0.5 < x.score < 1 for x in quality.score(odd, ones).collect()} == {True}


def test_hits_of_odd_inputs(odd):
    got = decontam.decontaminate(odd, odd.select(F.col("doc_id").alias("item_id"), "text").where("doc_id IN (0, 1, 3)"))
    equal_rows_equal_results(got, "hits")
    assert {x.doc_id: x.hits.contaminated for x in got.collect() if x.doc_id is not None}[3]


def test_tokens_of_odd_inputs(spark, odd):
    pieces = spm.load_pieces(spm.default_model())
    got = spm.round_trip(odd, pieces)
    assert got.columns.count("token_ids") == 1 and got.where("NOT round_trip").count() == 0
    equal_rows_equal_results(got, "token_ids")
    assert spm.round_trip(odd.limit(0), pieces).count() == 0


def test_models_of_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    for change in ("charsmap", "kind", "prefix"):
        m = pb.ModelProto()
        with open(spm.default_model(), "rb") as f:
            m.ParseFromString(f.read())
        if change == "charsmap":
            m.normalizer_spec.precompiled_charsmap = b"x"
        elif change == "kind":
            m.trainer_spec.model_type = 3
        else:
            m.normalizer_spec.add_dummy_prefix = False
        (tmp_path / change).write_bytes(m.SerializeToString())
        with pytest.raises(ValueError):
            spm.load_pieces(str(tmp_path / change))


def test_spans_of_odd_inputs(odd):
    got = secrets.scan(odd)
    equal_rows_equal_results(got, "secrets")
    assert got.count() == odd.count() and secrets.scan(odd.limit(0)).count() == 0


def test_languages_of_odd_inputs(odd):
    d = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    got = langid.identify(d, langid.train(d))
    equal_rows_equal_results(got, "language")
    assert {x.language.lang_pred for x in got.where("doc_id IN (0, 1, 2, 6)").collect()} == {"und"}
    assert langid.identify(d.limit(0), langid.train(d)).count() == 0


def test_urls_of_odd_inputs(spark):
    pages = spark.createDataFrame([(1, None), (1, "http://A.org/x"), (1, "http://A.org/x"), (None, "http://b.org"), (2, "://"), (3, "http://" + "a." * 20_000 + "org/")], "page_id long, url string").withColumn("blocked", F.lit(1))
    labels = spark.createDataFrame([(1, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = urlfilter.judge(pages, labels, ())
    assert got.count() == 6 and urlfilter.judge(pages.limit(0), labels, ()).count() == 0


def test_media_of_nothing(odd):
    assert media.from_media(media.to_media(odd.select("doc_id", "text").limit(0))).count() == 0


def test_archive_of_a_very_long_page(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é" * 2_000_000)], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/l")
    got = warc.reassemble(warc.read_parts(spark, f"{tmp_path}/l")).first()
    assert (got.status, got.payload_bytes, len(bytes(got.payload))) == ("whole", 4_000_000, 4_000_000) and got.n_segments > 900
