"""Scalar functions on small literals, with the boundaries."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import relational as R


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "lang"), [("the cat and the dog", "en"), ("the", "hi"), ("", "en"), ("xyz", "en")])
def test_language(spark, text, lang):
    assert one(spark, text, X.language) == lang


def test_mask(spark):
    assert one(spark, "a 1234-5678-9012-3456 b x@y.org c 123-45-6789", X.mask) == "a [MASKED] b [MASKED] c [MASKED]"


@pytest.mark.parametrize(("n", "said"), [(0, "0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1024**2, "1.0 MB")])
def test_file_size(spark, n, said):
    assert spark.range(1).select(X.file_size(F.lit(n))).first()[0] == said


def test_chunks(spark):
    assert one(spark, "a b c", lambda c: X.word_chunks(c, 2)) == ["a b", "c"]
    assert one(spark, "", X.stride_chunks) == []


def test_jaccard_of_nothing(spark):
    assert spark.range(1).select(X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 0.0


def test_page_bounds(spark):
    for limit, offset in ((0, 0), (1001, 0), (1, -1)):
        with pytest.raises(ValueError):
            R.page(spark.range(3), [F.col("id")], limit, offset)


def test_unknown_filters_are_ignored(spark):
    assert R.matching(spark.range(3), id=[1, 2], other=5).count() == 2
