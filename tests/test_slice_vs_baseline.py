"""FIXTURES F4."""

import pytest

from conftest import rows
from segstats import rate_by_value, reconcile_slice, slice_vs_baseline

SCHEMA = "tenure bigint, Churn string"


def frame(spark, tenure, churn):
    return spark.createDataFrame(list(zip(tenure, churn)), SCHEMA)


def one(df):
    out = rows(df)
    assert len(out) == 1
    return out[0]


def test_golden_row(spark):
    df = frame(spark, [0, 3, 6, 0, 6, 7, 7, 12, 72, -1], ["Yes", "Yes", "Yes", "No", "No", "Yes", "No", "No", "No", "No"])
    out = slice_vs_baseline(df)
    assert len(out.columns) == 13
    r = one(out)
    assert (r["slice_min_tenure"], r["slice_max_tenure"]) == (0, 6)
    assert (r["slice_customer_count"], r["slice_churned_count"], r["slice_retained_count"]) == (5, 3, 2)
    assert r["slice_churn_rate"] == pytest.approx(0.6)
    assert r["slice_population_share"] == pytest.approx(0.5)
    assert r["slice_churn_contribution"] == pytest.approx(0.75)
    assert (r["overall_customer_count"], r["overall_churned_count"]) == (10, 4)
    assert r["overall_churn_rate"] == pytest.approx(0.4)
    assert r["rate_difference"] == pytest.approx(0.2)
    assert r["relative_churn_rate"] == pytest.approx(1.5)


@pytest.mark.parametrize("t,inside", [(0, 1), (1, 1), (5, 1), (6, 1), (7, 0), (8, 0), (72, 0), (-1, 0)])
def test_bounds_inclusive(spark, t, inside):
    r = one(slice_vs_baseline(frame(spark, [t, 40], ["Yes", "No"])))
    assert r["slice_customer_count"] == inside and r["slice_churned_count"] == inside
    assert r["overall_customer_count"] == 2


def test_missing_tenure_outside_slice_inside_overall(spark):
    r = one(slice_vs_baseline(frame(spark, [2, None], ["Yes", "Yes"])))
    assert r["slice_customer_count"] == 1 and r["overall_customer_count"] == 2 and r["overall_churned_count"] == 2


def test_shares(spark):
    r = one(slice_vs_baseline(frame(spark, [1, 30, 40, 50, 60, 70], ["Yes"] * 5 + ["No"])))
    assert r["slice_churn_rate"] == 1.0
    assert r["slice_churn_contribution"] == pytest.approx(0.2)
    assert r["slice_population_share"] == pytest.approx(1 / 6)


def test_lower_than_baseline(spark):
    r = one(slice_vs_baseline(frame(spark, [1, 2, 3, 4, 30, 40, 50, 60], ["Yes", "No", "No", "No", "Yes", "Yes", "Yes", "No"])))
    assert r["slice_churn_rate"] == 0.25 and r["overall_churn_rate"] == 0.5
    assert r["rate_difference"] == pytest.approx(-0.25) and r["relative_churn_rate"] == pytest.approx(0.5)


def test_empty_slice_is_undefined_not_zero(spark):
    r = one(slice_vs_baseline(frame(spark, [30, 40, 50], ["Yes", "No", "No"])))
    assert r["slice_customer_count"] == 0
    assert r["slice_churn_rate"] is None and r["rate_difference"] is None and r["relative_churn_rate"] is None
    assert r["slice_population_share"] == 0.0 and r["slice_churn_contribution"] == 0.0


def test_no_churn_anywhere(spark):
    r = one(slice_vs_baseline(frame(spark, [1, 2, 30], ["No", "No", "No"])))
    assert r["slice_churn_rate"] == 0.0
    assert r["slice_churn_contribution"] is None and r["relative_churn_rate"] is None


def test_no_rows_still_one_row(spark):
    r = one(slice_vs_baseline(spark.createDataFrame([], SCHEMA)))
    assert r["slice_customer_count"] == 0 and r["overall_customer_count"] == 0
    assert r["slice_churn_rate"] is None and r["overall_churn_rate"] is None


def test_refuses_missing_label_inside_slice(spark):
    with pytest.raises(ValueError, match="no recorded 'Churn' value"):
        slice_vs_baseline(frame(spark, [1, 2, 30], ["Yes", None, "No"]))


def test_missing_label_outside_slice_counted_overall(spark):
    r = one(slice_vs_baseline(frame(spark, [1, 2, 30], ["Yes", "No", None])))
    assert r["slice_churn_rate"] == 0.5
    assert r["overall_customer_count"] == 3 and r["overall_churned_count"] == 1


def test_refuses_unexpected_label(spark):
    with pytest.raises(ValueError, match="outside"):
        slice_vs_baseline(frame(spark, [1, 2], ["Yes", "Unknown"]))


def test_reconcile_slice(spark):
    df = frame(spark, [0, 3, 6, 0, 6, 7, 7, 12, 72, -1], ["Yes", "Yes", "Yes", "No", "No", "Yes", "No", "No", "No", "No"])
    r = one(reconcile_slice(rate_by_value(df), slice_vs_baseline(df)))
    assert r["reconciles"] is True
    assert (r["value_customer_count"], r["value_churned_count"], r["value_retained_count"]) == (5, 3, 2)


def test_refuses_text_tenure_with_value_error(spark):
    df = spark.createDataFrame([("twelve", "No"), ("8", "Yes")], "tenure string, Churn string")
    with pytest.raises(ValueError, match="numeric"):
        slice_vs_baseline(df)


def test_label_refusal_comes_before_type_refusal(spark):
    df = spark.createDataFrame([("twelve", "Maybe")], "tenure string, Churn string")
    with pytest.raises(ValueError, match="outside"):
        slice_vs_baseline(df)


def test_refuses_integer_label_column(spark):
    with pytest.raises(ValueError, match="outside"):
        slice_vs_baseline(spark.createDataFrame([(1, 1), (2, 0)], "tenure bigint, Churn bigint"))
