"""NaN is missing in every check, and whole-number factors do not overflow."""

import math

import pytest

from conftest import rows
from segstats.operators import quality

NAN = float("nan")


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [(1, NAN, "a"), (1, None, "a"), (2, 0.0, "b"), (2, -0.0, "b"), (3, 1.5, " ")], "k bigint, x double, t string"
    )


def test_duplicates(df):
    assert rows(quality.count_duplicate_rows(df)) == [{"duplicate_rows": 2}]
    assert rows(quality.count_duplicate_ids(df, "x")) == [{"duplicate_ids": 2}]
    assert rows(quality.count_duplicate_ids(df, "t")) == [{"duplicate_ids": 2}]
    assert rows(quality.count_duplicate_rows(df.where("false"))) == [{"duplicate_rows": 0}]


def test_readability(spark):
    df = spark.createDataFrame([(NAN,), (1.0,), (None,)], "x double")
    got = {r["value_class"]: r["row_count"] for r in rows(quality.numeric_readability(df, "x"))}
    assert got == {"missing": 2, "blank": 0, "non_numeric": 0, "convertible": 1}


def test_class_context(df):
    assert rows(quality.class_context(df, "t", "x")) == [{"x": 1.5, "row_count": 1}]
    assert rows(quality.class_context(df, "t", "x", "non_numeric")) == [{"x": 0.0, "row_count": 2}]


def test_product_residual(spark):
    big = 4 * 10**18
    df = spark.createDataFrame(
        [(6.0, NAN, 2), (6.0, None, 2), (6.0, 3.0, 2), (7.0, 3.0, 2), (1.0, 4e18, big)], "t double, a double, b bigint"
    )
    r = rows(quality.product_residual(df, "t", "a", "b"))[0]
    assert (r["convertible_count"], r["zero_difference_count"], r["nonzero_difference_count"]) == (3, 1, 2)
    assert r["max_difference"] == 1.0 and math.isfinite(r["mean_abs_difference"])
    whole = spark.createDataFrame([(1.0, big, big)], "t double, a bigint, b bigint")
    assert rows(quality.product_residual(whole, "t", "a", "b"))[0]["convertible_count"] == 1


def test_a_sample_tells_that_nothing_is_affected(df):
    none = rows(quality.affected_sample(df, df["k"] > 99, ["k", "t"], ["k"]))
    assert none == [{"k": None, "t": None, "affected_count": 0}]
    some = rows(quality.affected_sample(df, df["k"] == 1, ["k"], ["k"], n=1))
    assert some == [{"k": 1, "affected_count": 2}]
