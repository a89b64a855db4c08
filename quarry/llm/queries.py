"""Queries of this subpackage by name, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, hardneg, langid, linededup, media, ngramjoin, quality, secrets, spelling, spm, suffixdedup, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        linededup.op1_line_dedup,
        warc.op2_warc_segments,
        ngramjoin.op3_ngram_jaccard,
        quality.op4_quality_classifier,
        decontam.op5_benchmark_decontamination,
        spm.op6_sentencepiece,
        urlfilter.op7_url_filter,
        media.op8_media_columns,
        secrets.op9_secret_scan,
        langid.op10_language_id,
        suffixdedup.op11_suffix_dedup,
        spelling.op12_spelling_variants,
        hardneg.op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": linededup.OP1_SQL,
    "op2_warc_segments": warc.OP2_SQL,
    "op3_ngram_jaccard": ngramjoin.OP3_SQL,
    "op5_benchmark_decontamination": decontam.OP5_SQL,
    "op7_url_filter": urlfilter.OP7_SQL,
    "op11_suffix_dedup": suffixdedup.OP11_SQL,
    "op13_hard_negatives": hardneg.OP13_SQL,
}
