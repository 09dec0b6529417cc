import math

import pytest
from pyspark.sql import functions as F

from notelake.functions import text as X
from notelake.functions.vectors import cosine
from notelake.operators import filters


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


SPACES = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0     　"


def test_strip_takes_every_white_space_python_takes(spark):
    assert one(spark, X.strip(F.lit(SPACES + "a b" + SPACES))) == "a b"
    assert SPACES.strip() == "" and one(spark, X.is_blank(F.lit(SPACES)))
    assert one(spark, X.normalized(F.lit("  Hello\tW \n"))) == "hello\tw"


@pytest.mark.parametrize(
    "raw, tags",
    [(None, []), ("", []), ("not json", []), ('{"a": 1}', []), ("[]", []), ('["x", "y"]', ["x", "y"])],
)
def test_parse_tags(spark, raw, tags):
    assert one(spark, X.parse_tags(F.lit(raw).cast("string"))) == tags


@pytest.mark.parametrize(
    "query, words",
    [
        ("to a", []), ("", []), ("Deploy the-app_now, ok", ["deploy", "the", "app", "now"]),
        ("data data", ["data", "data"]), ("one two", ["one", "two"]),
    ],
)
def test_keywords(spark, query, words):
    assert one(spark, X.keywords(F.lit(query))) == words
    assert one(spark, X.query_words(query)) == words


@pytest.mark.parametrize(
    "duration, cutoff",
    [("7d", "2024-03-24"), (" 2W ", "2024-03-17"), ("3m", "2024-01-01"), ("abc", None), ("7x", None), ("", None), (None, None)],
)
def test_duration(duration, cutoff):
    assert X.duration_cutoff(duration, "2024-03-31") == cutoff


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0),
        ([0.0, 0.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [0.0, 0.0], 0.0), ([1.0, 2.0], [1.0], None),
    ],
)
def test_cosine(spark, a, b, expected):
    got = one(spark, cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert got is None if expected is None else math.isclose(got, expected, abs_tol=1e-12)


def test_validation_order(spark):
    rows = spark.createDataFrame(
        [(1, " ", None, ""), (2, "r", " ", ""), (3, "r", "c", "\n"), (4, "r", "c", "t")],
        "id int, role string, category string, text string",
    )
    got = {r["id"]: r["reject_reason"] for r in filters.validate_entries(rows).collect()}
    assert got == {1: "role is required", 2: "category is required", 3: "text is required", 4: None}


def test_unparsed_duration_and_empty_filters_keep_all(entries):
    rows = entries([(1, "a"), (2, "b")])
    assert filters.filter_since(rows, "soon", "2024-01-01").count() == 2
    assert filters.filter_tag(filters.filter_role_category(rows, "coder", ""), None).count() == 2
