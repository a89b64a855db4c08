"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result
is written as Parquet in the shared folder and read again as the next stage's documents.
The last stage's rows hold packed token ids in place of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, linededup, ngramjoin, quality, spm
from quarry.llm.common import staged

STAGES = [
    ("quality_classifier", quality.stage),
    ("line_dedup", linededup.stage),
    ("ngram_jaccard_join", ngramjoin.stage),
    ("benchmark_decontamination", decontam.stage),
    ("sentencepiece", spm.stage),
]

#: SQL can express neither the classifier nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
