"""FIXTURES F3."""

import pytest

from conftest import rows
from segstats import rate_by_value

SCHEMA = "tenure bigint, Churn string"
COLUMNS = ["tenure_month", "customer_count", "churned_count", "retained_count", "churn_rate"]


def frame(spark, tenure, churn, schema=SCHEMA):
    return spark.createDataFrame(list(zip(tenure, churn)), schema)


def test_golden_table(spark):
    df = frame(spark, [0, 1, 1, 2, 2, 2], ["No", "Yes", "No", "Yes", "Yes", "No"])
    out = rate_by_value(df)
    assert out.columns == COLUMNS
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint"] * 4 + ["double"]
    assert [tuple(r.values()) for r in rows(out)] == [(0, 1, 0, 1, 0.0), (1, 2, 1, 1, 0.5), (2, 3, 2, 1, 2 / 3)]


@pytest.mark.parametrize(
    "tenure,churn,expected",
    [
        ([1, 1, 5, 5], ["Yes", "Yes", "No", "No"], [(1, 1.0), (5, 0.0)]),
        ([1, 72], ["Yes", "No"], [(1, 1.0), (72, 0.0)]),
        ([0, 2, 5, 7], ["No", "Yes", "No", "Yes"], [(0, 0.0), (2, 1.0), (5, 0.0), (7, 1.0)]),
        ([-1, 3], ["Yes", "No"], [(-1, 1.0), (3, 0.0)]),
    ],
)
def test_only_observed_values_in_order(spark, tenure, churn, expected):
    out = rows(rate_by_value(frame(spark, tenure, churn)))
    assert [(r["tenure_month"], r["churn_rate"]) for r in out] == expected


def test_ascending_order(spark):
    out = rows(rate_by_value(frame(spark, [30, 2, 71, 0, 2, 9], ["Yes", "No", "No", "Yes", "Yes", "No"])))
    assert [r["tenure_month"] for r in out] == [0, 2, 9, 30, 71]


def test_zero_month(spark):
    out = rows(rate_by_value(frame(spark, [0, 0, 4], ["Yes", "No", "No"])))
    assert (out[0]["tenure_month"], out[0]["customer_count"], out[0]["churned_count"], out[0]["churn_rate"]) == (0, 2, 1, 0.5)


def test_missing_tenure_enters_no_row(spark):
    out = rows(rate_by_value(frame(spark, [2, 2, None], ["Yes", "No", "Yes"])))
    assert len(out) == 1 and out[0]["customer_count"] == 2 and out[0]["churned_count"] == 1


def test_missing_label_with_missing_tenure_tolerated(spark):
    out = rows(rate_by_value(frame(spark, [1, None], ["Yes", None])))
    assert len(out) == 1 and out[0]["customer_count"] == 1


def test_refuses_missing_label_with_tenure(spark):
    with pytest.raises(ValueError, match="no recorded 'Churn' value"):
        rate_by_value(frame(spark, [1, 2, 3], ["Yes", None, "No"]))


def test_empty_keeps_schema(spark):
    for df in (spark.createDataFrame([], SCHEMA), frame(spark, [None, None], ["Yes", "No"])):
        out = rate_by_value(df)
        assert out.columns == COLUMNS and out.collect() == []
        assert out.schema["tenure_month"].dataType.simpleString() == "bigint"


def test_double_tenure_keeps_type(spark):
    out = rate_by_value(frame(spark, [1.0, 2.0], ["Yes", "No"], "tenure double, Churn string"))
    assert out.schema["tenure_month"].dataType.simpleString() == "double"


def test_reconciles(spark):
    out = rows(rate_by_value(frame(spark, [1, 1, 2, 3, 3, 3], ["Yes", "No", "No", "Yes", "Yes", "No"])))
    assert all(r["customer_count"] == r["churned_count"] + r["retained_count"] for r in out)
    assert sum(r["customer_count"] for r in out) == 6


@pytest.mark.parametrize("label", ["Unknown", "yes", "1"])
def test_refuses_unexpected_label(spark, label):
    with pytest.raises(ValueError, match="outside"):
        rate_by_value(frame(spark, [1, 2], ["No", label]))


def test_refuses_text_tenure(spark):
    with pytest.raises(ValueError, match="numeric"):
        rate_by_value(frame(spark, ["12", "8"], ["No", "Yes"], "tenure string, Churn string"))


def test_refuses_integer_label_column(spark):
    with pytest.raises(ValueError, match="outside"):
        rate_by_value(spark.createDataFrame([(1, 1), (2, 0)], "tenure bigint, Churn bigint"))
