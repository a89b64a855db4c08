"""The corpus pipeline on a small corpus: every stage's decisions, columns and lineage."""

import numpy as np

import corpus_pipeline
from quarry.llm import spm


def test_stages_take_effect(spark, tmp_path):
    import random

    r = random.Random(8)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    good = [prose(80) + "\n" + prose(60) for _ in range(120)]
    item = prose(30)
    texts = [*good, *("!! ## " * 40 for _ in range(60)), good[0], good[1].replace(words[0], "q", 1) + " end", item + " " + prose(20), good[2] + "\n" + good[3].split("\n")[0]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120 or i >= 180), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    kept, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x.doc_id: x for x in at.collect()}
        if name != "sentencepiece":
            assert at.columns == docs.columns
    assert set(range(120)) <= set(kept["quality_classifier"]) and not set(range(120, 180)) & set(kept["quality_classifier"])
    # documents whose lines all came before have nothing left to keep
    assert not {180, 181, 183} & set(kept["line_dedup"])
    assert all(x.n_chars == len(x.text) for x in kept["line_dedup"].values())
    clean = set(range(120))
    assert clean <= set(kept["ngram_jaccard_join"])
    assert clean <= set(kept["benchmark_decontamination"]) and 182 not in kept["benchmark_decontamination"]
    v = spm.Vocabulary(**spm.load_pieces(spm.default_model()))
    for i in range(120):
        x = kept["sentencepiece"][i]
        assert x.round_trip and v.decode(bytes(x.token_ids)) == good[i] and x.n_tokens == len(np.frombuffer(bytes(x.token_ids), "<i4"))
    got = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(kept["sentencepiece"])


def test_odd_documents_pass_through_all_stages(spark, tmp_path):
    """Null and empty texts, repeated rows, null ids and clashing names; then no documents at all."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(words[(i * k + k) % 10] for k in range(40)) + f" number {i}", 9) for i in range(30)]
    rows += [(100, None, 9), (101, "", 9), (102, "short", 9), (None, "a text without an id " + " ".join(words * 3), 9), rows[0], rows[0], (103, rows[1][1], 9), (104, "x" * 50_000, 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, word string, score string, fragment int, cid long, gone string, label string"
    full = [(i, t, "en", "s", None if t is None else len(t), "w", "s", n, 1, "g", "l") for i, t, n in rows]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(102, 0, 0), (104, 0, 0)], "doc_id long, quality int, toxic int")
    item = spark.createDataFrame([(1, "an item that no document holds at all in its text anywhere here today")], "item_id long, text string")
    for name, docs in (("some", spark.createDataFrame(full, schema)), ("none", spark.createDataFrame([], schema))):
        d = f"{tmp_path}/{name}"
        docs.write.parquet(f"{d}/documents.parquet"), labels.write.parquet(f"{d}/labels.parquet"), item.write.parquet(f"{d}/benchmark.parquet")
        at = spark.read.parquet(f"{d}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            at = f(spark, at, d)
            assert at.columns == docs.columns
            at.write.parquet(f"{d}/{stage}")
            at = spark.read.parquet(f"{d}/{stage}")
        out = corpus_pipeline.STAGES[-1][1](spark, at, d).collect()
        assert len(out) == at.count() and (name == "some") == bool(out)
        if out:
            assert all(x.round_trip for x in out) and {x.doc_id for x in out} & set(range(30))
