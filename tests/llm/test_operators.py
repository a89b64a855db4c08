"""Operators for training text on small fixtures, against brute force, the library, or a round trip."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, linededup, media, ngramjoin, quality, secrets, spm, urlfilter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_hit string"
rng = random.Random(7)
VOCAB = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
sentence = lambda n: " ".join(rng.choices(VOCAB, k=n))


def edited(text, k):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), k):
        w[i] = "zz" + str(rng.randint(0, 9999))
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    base = [sentence(60) for _ in range(12)]
    near = [edited(b, k) for b in base[:6] for k in (1, 1, 2, 4)]
    return [None, "", " \n ", "one", "one two", *base, *near, base[0], base[0], "\n".join([base[1], near[4], base[7], ""]), sentence(20_000), "Ä ö\n" * 3]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    top = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            o = len(sets[i] & sets[j])
            if sets[i] and den * o >= num * len(sets[i] | sets[j]):
                top[i] = top[j] = min(top[i], top[j])
    return [(i, len(s), t) for i, (s, t) in enumerate(zip(sets, top, strict=True))]


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
def test_components(docs, texts, n, num):
    got = sorted(map(tuple, ngramjoin.similar_components(docs, n, num, 100).collect()))
    assert got == brute_components(texts, n, num, 100)


def test_components_of_nothing(no_docs):
    assert ngramjoin.similar_components(no_docs).count() == 0


def test_one_of_each_keeps_columns_and_repeated_ids_once(docs):
    kept = ngramjoin.one_of_each(docs.union(docs))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if (r.text or "").strip()]
    assert len(ids) == len(set(ids))


def test_one_of_each_decides_by_row(spark):
    a, b, c, e = (sentence(60) for _ in range(4))
    # id 5 has a copy of id 1's text and two texts of its own; id 7 has one text twice
    rows = [(1, a), (5, a), (5, b), (5, c), (7, e), (7, e), (8, edited(e, 1)), (9, ""), (9, ""), (None, a)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ngramjoin.one_of_each(d).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (5, c), (7, e), (9, ""), (9, ""), (None, a)], key=str)


def brute_lines(texts, num=80, den=100):
    seen, out = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            w = set(line.lower().split())
            if not w or not any(den * len(w & s) >= num * len(w | s) for s in seen):
                kept.append(line)
            if w:
                seen.append(w)
        out.append(None if t is None else "\n".join(kept))
    return out


def test_line_dedup(docs, texts):
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def test_line_dedup_of_nothing_and_of_repeated_rows(docs, no_docs):
    assert linededup.dedup_lines(no_docs).count() == 0
    twice = linededup.dedup_lines(docs.union(docs))
    assert twice.groupBy("doc_id").agg(F.countDistinct("text").alias("n")).where("n > 1").count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "x" * 9000, "short", "short", "é" * 5000, "a\r\n\r\nb0\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(None, None, "short")], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w")
    got = {r.page_id: r for r in warc.reassemble(warc.read_parts(spark, f"{tmp_path}/w")).collect()}
    for i, h in enumerate(html):
        r, data = got[str(i)], (h or "").encode()
        assert (r.status, r.payload_bytes, r.payload_digest) == ("whole", len(data), warc.digest32(data))
        assert r.record_type == ("revisit" if i in (0, 3) else "response")
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    assert got[None].record_type == "revisit" and got[None].refers_to == "4"
    assert got["2"].n_segments > 1


def test_warc_damage():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.frame(b"hello" * 9, 7)
    f = {"warc-type": "response", "warc-payload-digest": "sha1:" + warc.digest32(b"hello" * 9)}
    parts = [(2, len(block), block[30:]), (1, None, block[:30])]
    assert warc.assemble(parts, f)[:3] == ("whole", 2, b"hello" * 9)
    for bad in ([parts[0]], [parts[0], parts[0], parts[1]], [(2, 5, block[30:]), parts[1]], [(3, len(block), block[30:]), parts[1]]):
        assert warc.assemble(bad, f)[0] == "damaged"
    assert warc.assemble(parts, f | {"warc-payload-digest": "sha1:X"})[0] == "damaged"


def test_warc_chunk_sizes_are_strict():
    assert warc.unframe(b"5 ;x=y\r\nhello\r\n00\r\n\r\n") == b"hello"
    for size in (b"-6", b"+5", b"1_0", b" 5", b"0x5", b"", b"g", b"7fffffffffffffff", b"5" * 40, b"6"):
        with pytest.raises(ValueError):
            warc.unframe(b"1\r\nA\r\n" + size + b"\r\nhello\r\n0\r\n\r\n")


def test_warc_revisits_need_their_response(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "same" if i < 5 else f"own {i}") for i in range(8)], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/r")
    records = warc.reassemble(warc.read_parts(spark, f"{tmp_path}/r"))
    got = {r.page_id: r for r in warc.resolved(records).collect()}
    assert len(got) == 8 and all(r.status == "whole" and r.payload_bytes == (4 if int(i) < 5 else 5) for i, r in got.items())
    assert all(got[str(i)].refers_to == "4" and got[str(i)].payload_digest == got["4"].payload_digest for i in range(4))
    lost = warc.resolved(records.where("page_id <> '4'"))
    assert sorted((r.page_id, r.status, r.payload_bytes) for r in lost.where("record_type = 'revisit'").collect()) == [(str(i), "damaged", None) for i in range(4)]
    other = warc.resolved(records.withColumn("payload_digest", F.when(F.col("page_id") == "4", "X").otherwise(F.col("payload_digest"))))
    assert other.where("status = 'damaged'").count() == 4


def test_warc_damaged_files_give_rows(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i + 10) + str(i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w")
    path = next(tmp_path.glob("w/part-*"))
    data = path.read_bytes()
    plain, whole = warc._inflated(data)
    assert whole
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for n, bad in enumerate((data[: len(data) // 2], data[:600] + b"\0" * 9 + data[609:], plain[:-40], plain + b"rubbish", plain.replace(b"Content-Length: ", b"Content-Length: x", 1), b"\x1f\x8b", b"rubbish", info + plain)):
        at = tmp_path / f"bad{n}"
        at.mkdir()
        (at / "part-0.warc").write_bytes(bad)
        rows = warc.reassemble(warc.read_parts(spark, str(at))).collect()
        sound = [r for r in rows if r.status == "whole"]
        assert all(r.payload_digest == warc.digest32(bytes(r.payload)) for r in sound)
        assert len(rows) - len(sound) == (0 if bad.startswith(info) else 1), n
        assert len(sound) == (40 if n in (3, 7) else len(sound))


def test_warc_of_nothing_and_of_repeated_rows(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(none, f"{tmp_path}/n")
    assert warc.reassemble(warc.read_parts(spark, f"{tmp_path}/n")).count() == 0
    twice = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, None, "same")], "page_id long, url string, html string").withColumn("status", F.lit(0))
    warc.write_archives(twice, f"{tmp_path}/t")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.reassemble(warc.read_parts(spark, f"{tmp_path}/t")).collect())
    assert got == [("1", "revisit", "2"), ("1", "revisit", "2"), ("2", "response", "")] or got[2][2] in ("", None)


def test_decontamination_of_nothing_and_of_repeated_rows(spark, no_docs):
    bench = spark.createDataFrame([(1, "rare pair")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a rare pair"), (1, "a rare pair"), (None, "rare pair " * 30_000)], "doc_id long, text string")
    assert decontam.decontaminate(no_docs, bench).count() == 0
    assert [r.hits.n_hit for r in decontam.decontaminate(docs, bench.limit(0)).collect()] == [0, 0, 0]
    assert sorted(r.hits.n_hit for r in decontam.decontaminate(docs, bench).collect()) == [2, 2, 60_000]


def test_pieces_of_items_keep_every_window():
    for n, window, most in ((40, 13, 30), (40, 5, 1), (13, 13, 10), (12, 13, 10), (200, 13, 300), (1, 3, 1)):
        text = sentence(n).encode()
        parts = decontam.pieces(text, window, most)
        assert set().union(*(decontam.windows_of(p, window) for p in parts)) == decontam.windows_of(text, window)
        assert n < 2 * window or len(parts) > 1
    assert decontam.pieces(b"!! ", 13, 10) == [b""]


def test_decontamination_in_parts(spark):
    bench = spark.createDataFrame([(i, sentence(60)) for i in range(12)], "item_id long, text string")
    items = [r.text for r in bench.collect()]
    texts = [" ".join([sentence(5), *(items[(i + k) % 12][k * 10 :] for k in range(i % 4)), sentence(7)]) for i in range(30)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda df: {r.doc_id: r.hits for r in df.collect()}
    whole = rows(decontam.decontaminate(docs, bench))
    assert any(h.n_hit for h in whole.values()) and rows(decontam.decontaminate(docs, bench, max_item_bytes=1500)) == whole


def test_decontamination(spark):
    item, short = sentence(30), "rare pair"
    t = [f"{sentence(50)}, {item.upper()}! {sentence(5)}", "A Rare-pair.", sentence(300) + " " + " ".join(item.split()[:13]), None, "", " ".join(item.split()[:12])]
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, short), (3, None), (None, "x"), (4, "..."), (5, item)], "item_id long, text string")
    # items beyond the bound are scanned in parts, with the same result
    whole = {r.doc_id: r.hits for r in decontam.decontaminate(docs, bench).collect()}
    assert {r.doc_id: r.hits for r in decontam.decontaminate(docs, bench, max_item_bytes=120).collect()} == whole
    for table in (docs, docs.withColumn("hits", F.lit(1))):
        got = {r.doc_id: r.hits for r in decontam.decontaminate(table, bench).collect()}
        assert [(got[i].n_hit, got[i].contaminated, list(got[i]["items"])) for i in range(6)] == [(30, True, ["1", "5"]), (2, True, ["2"]), (13, False, ["1", "5"]), (0, False, []), (0, False, []), (0, False, [])]
    s = got[0].spans[0]
    assert t[0][s.start : s.end] == item.upper()


def test_tokens_match_the_library(docs, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp, pieces = sentencepiece.SentencePieceProcessor(model_file=spm.default_model()), spm.load_pieces(spm.default_model())
    for r in spm.round_trip(docs.select("doc_id", "text"), pieces).collect():
        assert np.frombuffer(bytes(r.token_ids), "<i4").tolist() == sp.encode(r.text or "") and r.round_trip
    v = spm.Vocabulary(**pieces)
    odd = ["a  b", " x ", "\x00\t日本 😀", "a" * 700, "==" * 300, "    "]
    assert [np.frombuffer(x, "<i4").tolist() for x in v.encode(odd)] == [sp.encode(x) for x in odd]


def test_viterbi_is_the_best_path():
    pieces = [("<unk>", 0.0, "unknown"), *((p, -float(len(p)) * k, "normal") for k, p in zip((1.0, 1.3, 0.9, 0.7, 1.1, 0.8), ("a", "b", "▁", "ab", "ba", "▁a"), strict=True))]
    v = spm.Vocabulary(pieces, "unigram")

    def best(w):
        return max((sum(v.scores[w[i:j]] for i, j in zip((0, *c), (*c, len(w)), strict=True)) for n in range(len(w)) for c in itertools.combinations(range(1, len(w)), n) if all(w[i:j] in v.scores for i, j in zip((0, *c), (*c, len(w)), strict=True))))

    for n in range(2, 7):
        words = ["▁" + "".join(x) for x in itertools.product("ab", repeat=n)]
        for w, found in zip(words, v._viterbi(words), strict=True):
            assert sum(v.scores[w[i:j]] for i, j in found) == pytest.approx(best(w))
            assert sum(v.scores[w[i:j]] for i, j in v._viterbi_long(w)) == pytest.approx(best(w))


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q", "http://net/en/", "http://example.com/de/", "http://x.example.com/fr/", "https://o.org/fr/#t", "http://notexample.net", None, "no scheme", "http://h"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [tuple(r)[1:] for r in sorted(urlfilter.judge(pages, labels).collect())]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("net", "/en/", "net/", "block"), ("example.com", "/de/", "example.com/de/", "block"), ("x.example.com", "/fr/", None, "allow"),
        ("o.org", "/fr/", "org/fr/", "allow"), ("notexample.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"),
    ]


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else f'h{i % 20}'}.com/") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(400)] + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert {r.host for r in urlfilter.judge(pages, labels).where("verdict = 'block'").collect()} == {"bad.com"}


def test_suffixes_of_several_labels(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.org", "y.org", "org", "h", "", "1.2.3.com.au"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urlfilter.registered_domain(F.col("h")).alias("d"), urlfilter.suffix_of(F.col("h")).alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in rows} == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.org": ("y.org", "org"), "y.org": ("y.org", "org"), "org": ("org", "org"), "h": ("h", "h"), "": ("", ""), "1.2.3.com.au": ("3.com.au", "com.au"),
    }


def brute_reputation(pages, labels):
    """host: (n, bad, lower bound) in plain Python."""
    bad = {}
    for i, q, t in labels:
        if i is not None and (q is not None or t is not None):
            bad[i] = max(bad.get(i, 0), int(q == 0 or t == 1))
    cut = lambda h: (".".join(h.split(".")[-2:]), h.split(".")[-1])  # noqa: E731  (one-label suffixes only)
    hosts = {}
    for i, h in pages:
        if h:
            n = hosts.setdefault(h, [0, 0])
            if i in bad:
                n[0] += 1
                n[1] += bad[i]

    def sums(level):
        out = {}
        for h, (n, b) in hosts.items():
            x = out.setdefault(cut(h)[level], [0, 0])
            x[0] += n
            x[1] += b
        return {k: v for k, v in out.items() if v[0]}

    def fit(groups, prior):
        own = {k: v for k, v in groups.items() if v[0]}
        num = sum(n * (b / n - prior[k]) ** 2 - prior[k] * (1 - prior[k]) for k, (n, b) in own.items())
        den = sum((n - 1) * prior[k] * (1 - prior[k]) for k, (n, b) in own.items())
        m = 1 / min(0.5, max(0.001, num / den if den else 0.001)) - 1
        return {k: (b + m * prior[k], n - b + m * (1 - prior[k])) for k, (n, b) in groups.items()}

    mean = lambda ab: {k: a / (a + b) for k, (a, b) in ab.items()}
    total = sum(b for _, b in hosts.values()) / sum(n for n, _ in hosts.values())
    s = mean(fit(sums(1), dict.fromkeys(sums(1), total)))
    of = {cut(h)[0]: cut(h)[1] for h in hosts}
    d = mean(fit(sums(0), {k: s[of[k]] for k in sums(0)}))
    prior = {h: d.get(cut(h)[0], s.get(cut(h)[1], total)) for h in hosts}
    ab = fit(hosts, prior)
    return {h: (*hosts[h], max(0.0, a / (a + b) - 1.645 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)) for h, (a, b) in ab.items()}


def test_reputation_equals_brute_force(spark):
    r = random.Random(5)
    names = [f"h{i}.d{i % 7}.{('com', 'org', 'xyz')[i % 3]}" for i in range(60)] + ["lone.net"]
    pages = [(i, r.choice(names)) for i in range(1500)] + [(None, "null.d1.com"), (3, names[0]), (9000, ""), (9001, None)]
    labels = [(i, int(r.random() > (0.9 if h and ".d3." in h else 0.2)), r.choice((0, 0, 1, None))) for i, h in pages if i is not None and i % 3 and not (h or "").startswith("h1")] + [(3, 0, None), (None, 0, 1), (77777, 0, 1)]
    p = spark.createDataFrame(pages, "page_id long, host string").repartition(3)
    got = urlfilter.host_reputation(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_reputation(pages, labels)
    assert {x.host for x in got} == set(want)
    for x in got:
        assert (x.n, x.bad) == want[x.host][:2] and x.posterior_low == pytest.approx(want[x.host][2], abs=1e-9)
    assert urlfilter.host_reputation(p.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_hosts_without_labels_follow_their_domain(spark):
    hosts = [f"h{i}.{d}" for d in ("bad.com", "ok.org") for i in range(40)]
    urls = [f"http://{h}/{i}" for h in hosts for i in range(20)]
    new = ["http://new.bad.com/", "http://new.ok.org/", "http://new.other.com/", "http://new.elsewhere.xyz/"]
    pages = spark.createDataFrame(list(enumerate(urls + new)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("ok.org" in u), 0) for i, u in enumerate(urls)], "doc_id long, quality int, toxic int")
    got = {r.host: r.verdict for r in urlfilter.judge(pages, labels, ()).collect()}
    assert all(got[h] == ("block" if "bad.com" in h else "allow") for h in hosts)
    assert [got[u[7:-1]] for u in new] == ["block", "allow", "block", "allow"]
    rep = {r.host: r for r in urlfilter.host_reputation(pages.select("page_id", urlfilter.host_of(F.col("url")).alias("host")), labels).collect()}
    assert len(rep) == 84 and (rep["new.bad.com"].n, rep["new.bad.com"].bad) == (0, 0) and rep["new.bad.com"].posterior_low > 0.99
    assert abs(rep["new.elsewhere.xyz"].posterior_mean - 0.5) < 1e-9
    none = urlfilter.judge(pages, labels.where("false"), ())
    assert none.count() == len(urls + new) and none.where("verdict <> 'allow'").count() == 0


def test_media_round_trip(docs, texts):
    for r in media.from_media(media.to_media(docs)).collect():
        data = (texts[r.doc_id] or "").encode()
        assert r.read.payload_sha256 == hashlib.sha256(media.padded(data)).hexdigest() and r.n_bytes == r.read.n_bytes == len(data)


def test_png_filters_and_damage():
    x = np.random.default_rng(1).integers(0, 256, (9, 13), np.uint8)
    left, up = np.pad(x, ((0, 0), (1, 0)))[:, :-1].astype(int), np.pad(x, ((1, 0), (0, 0)))[:-1].astype(int)
    corner = np.pad(x, ((1, 0), (1, 0)))[:-1, :-1].astype(int)
    p = left + up - corner
    d = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
    paeth = np.choose(d.argmin(0), (left, up, corner))
    for kind, guess in enumerate((0 * left, left, up, (left + up) // 2, paeth)):
        rows = np.concatenate((np.full((9, 1), kind), (x - guess) % 256), 1).astype(np.uint8)
        assert (media.unfilter(rows) == x).all()
    png = media.encode_png(x, b"n")
    assert (media.decode_png(png)[0] == x).all()
    for at in range(0, len(png), 7):
        with pytest.raises(ValueError):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])


def test_secrets(spark):
    key = "q8Zr2LxV0bT7nKdY4mWcE1sHfJ6uPgA9"
    t = ["é password: hunter22 x", f'API_KEY="{key}"', f"see {key} there", "xxxxxxxxxx1xxxxxxxxxx1xxxxxxxxxx", "AKIA" + "B7" * 8 + " " + "0123456789abcdef" * 2, "token=abc", None, "", "password: token: abcdefg"]
    # ordinary text beside runs is what they are compared with
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(t)] + [(100 + i, "word" * 8 + "1 " + sentence(400)) for i in range(30)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(docs).select("doc_id", secrets.joined(F.col("secrets.base")).alias("base"), secrets.joined(F.col("secrets.all")).alias("all"), secrets.redact(F.col("text"), F.col("secrets.all")).alias("red")).collect()}
    assert [got[i].base for i in range(9)] == ["assign:2:20", f"assign:0:{9 + len(key)}", "", "", "access:0:20,hex:21:53", "", "", "", ""]
    assert got[2].all == f"rand:4:{4 + len(key)}" and got[3].all == "" and got[100].all == ""
    assert got[0].red == "é [SECRET] x" and got[2].red == "see [SECRET] there"


def test_secrets_of_every_alphabet(spark):
    r = random.Random(3)
    draw = lambda abc, n: "".join(r.choices(abc, k=n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    grouped = lambda abc, *n: "-".join(draw(abc, k) for k in n)
    kinds = [lambda: draw(lower + digits, 40), lambda: draw(upper + digits, 40), lambda: grouped(digits + "abcdef", 8, 4, 4, 4, 12), lambda: grouped(upper + digits, 5, 5, 5, 5, 5, 5), lambda: grouped(lower + digits, 8, 8, 8, 8), lambda: grouped(lower + upper + digits, 5, 5, 5, 5, 5, 5), lambda: draw(lower + upper + digits, 40), lambda: draw(upper + "234567", 32)]
    keys = [(k, make()) for k, make in enumerate(kinds) for _ in range(20)]
    # ordinary text, of which most must still be rejected, and far more than keys
    plain = ["-".join(["chapter", "the", "history", "of", "another", "little", "river"][: 5 + i % 3]) + f"-{i}" for i in range(30)] + ["item-1" + "-" * 40, "word" * 8 + "1"]
    # ordinary text of the same words is what runs are compared with
    words = ["chapter", "the", "history", "of", "another", "little", "river"]
    prose = lambda n: " ".join(r.choices(words, k=n))
    docs = spark.createDataFrame([(i, f"see {k} there {prose(300)} {prose(60).upper()}") for i, (_, k) in enumerate(keys)] + [(1000 + i, x) for i, x in enumerate(plain)], "doc_id long, text string")
    got = {x.doc_id: x.n for x in secrets.scan(docs).select("doc_id", F.size("secrets.all").alias("n")).collect()}
    found = [sum(got[i] for i, (j, _) in enumerate(keys) if j == k) for k in range(len(kinds))]
    assert min(found) >= 17, found
    assert sum(got[1000 + i] for i in range(len(plain))) <= 6


def labelled(spark, n=400):
    rows = [(i, edited(sentence(40), 2) if i % 3 else "!! ## " * 30, i % 3 and 1, 0) for i in range(n)]
    d = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    return d, spark.createDataFrame([(i, int(q), x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, no_docs):
    d, l = labelled(spark)
    m = quality.train(d, l)
    s = {r.doc_id: r.score for r in quality.score(d, m).collect()}
    assert all((s[i] >= quality.THRESHOLD) == bool(i % 3) for i in s)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, m).collect()) and quality.score(no_docs, m).count() == 0
    assert {r.score for r in quality.score(docs, quality.train(d, l.limit(0))).collect()} == {0.5}


def test_language_mixture(spark, no_docs):
    mk = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(80))
    rows = [(i, mk("abcde") if i % 2 else mk("vwxyzé"), ("aa", "zz")[1 - i % 2]) for i in range(120)]
    d = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 ..", "zz"), (902, mk("abcde") + " " + mk("vwxyzé"), None)], "doc_id long, text string, lang string")
    m = langid.train(d)
    got = {r.doc_id: r.language for r in langid.identify(d, m).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert set(got[902].languages.split(",")) == {"aa", "zz"} and 0.3 < got[902].score < 0.7
    assert langid.train(no_docs) is None and langid.identify(d, None).where("language.lang_pred <> 'und'").count() == 0


def test_mixture_of_more_than_four_languages(spark):
    alphabets = ("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx")
    mk = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(80))
    rows = [(i, mk(alphabets[i % 6]), alphabets[i % 6]) for i in range(180)]
    mixed = [(900 + n, " ".join(mk(a) for a in alphabets[:n]), None) for n in (4, 5, 6)]
    d = spark.createDataFrame([*rows, *mixed], "doc_id long, text string, lang string")
    got = {r.doc_id: r.language for r in langid.identify(d, langid.train(d)).collect()}
    assert all(got[i].languages == x for i, _, x in rows)
    for n in (4, 5, 6):
        assert set(got[900 + n].languages.split(",")) == set(alphabets[:n])
        assert abs(got[900 + n].score - 1 / n) < 0.05
