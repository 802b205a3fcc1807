"""FIXTURES F2 and F6."""

import math

import pytest

from conftest import rows
from segstats import retention_baseline, segment_rates, status_table

SCHEMA = "Contract string, Churn string"
COUNTS = [("Month-to-month", 2, 2), ("One year", 1, 4), ("Two year", 0, 2), ("Unknown", 1, 1), (None, 1, 1)]


def contract_frame(spark, counts=COUNTS):
    data = []
    for value, yes, no in counts:
        data += [(value, "Yes")] * yes + [(value, "No")] * no
    return spark.createDataFrame(data, SCHEMA)


def test_golden_table(spark):
    out = segment_rates(contract_frame(spark), 30.0)
    assert out.columns == [
        "contract", "value_status", "customer_count", "churned_count", "churn_rate_percent", "difference_percentage_points",
    ]
    got = [tuple(r.values()) for r in rows(out)]
    assert got == [
        ("Month-to-month", "expected", 4, 2, 50.0, 20.0),
        ("One year", "expected", 5, 1, 20.0, -10.0),
        ("Two year", "expected", 2, 0, 0.0, -30.0),
        ("Unknown", "unexpected", 2, 1, 50.0, 20.0),
        (None, "missing", 2, 1, 50.0, 20.0),
    ]


def test_groups_partition_the_input(spark):
    out = rows(segment_rates(contract_frame(spark), 30.0))
    assert sum(r["customer_count"] for r in out) == 15


def test_empty_expected_value_keeps_row(spark):
    counts = [c for c in COUNTS if c[0] != "Two year"]
    out = rows(segment_rates(contract_frame(spark, counts), 30.0))
    two = [r for r in out if r["contract"] == "Two year"][0]
    assert two["customer_count"] == 0 and two["churned_count"] == 0
    assert two["churn_rate_percent"] is None and two["difference_percentage_points"] is None


def test_no_missing_row_without_missing_values(spark):
    counts = [c for c in COUNTS if c[0] is not None]
    out = rows(segment_rates(contract_frame(spark, counts), 30.0))
    assert all(r["value_status"] != "missing" for r in out)


def test_unexpected_by_frequency(spark):
    counts = COUNTS + [("Weekly", 3, 0), ("Daily", 1, 0)]
    out = rows(segment_rates(contract_frame(spark, counts), 30.0))
    assert [r["contract"] for r in out if r["value_status"] == "unexpected"] == ["Weekly", "Unknown", "Daily"]


@pytest.mark.parametrize("baseline", [-0.1, 100.1, math.nan])
def test_refuses_baseline_outside_percent(spark, baseline):
    with pytest.raises(ValueError, match="between 0 and 100"):
        segment_rates(contract_frame(spark), baseline)


def test_proportion_baseline_passes_range_check(spark):
    assert len(rows(segment_rates(contract_frame(spark), 0.2654))) == 5


@pytest.mark.parametrize("drop", ["Contract", "Churn"])
def test_refuses_missing_column(spark, drop):
    with pytest.raises(ValueError, match="Required column"):
        segment_rates(contract_frame(spark).drop(drop), 30.0)


def labels(spark, values):
    return spark.createDataFrame([(v,) for v in values], "Churn string")


def test_retention_baseline(spark):
    r = rows(retention_baseline(labels(spark, ["Yes", "No", "No", "Maybe", "Maybe", "yes", None])))[0]
    assert (r["total_customers"], r["retained_count"], r["churned_count"], r["missing_count"], r["unexpected_count"]) == (7, 2, 1, 1, 3)
    assert r["retained_percent"] == pytest.approx(200 / 7)
    assert r["retained_minus_churned"] == 1
    assert r["has_unexpected_values"] is True


def test_retention_baseline_empty(spark):
    r = rows(retention_baseline(labels(spark, [])))[0]
    assert r["total_customers"] == 0 and r["retained_percent"] == 0.0 and r["churned_percent"] == 0.0
    assert r["has_unexpected_values"] is False


def test_status_table(spark):
    out = rows(status_table(labels(spark, ["Yes", "No", "No", "Maybe", "Maybe", "yes", None])))
    assert [(r["status"], r["customer_count"]) for r in out] == [
        ("Retained", 2), ("Churned", 1), ('Unexpected: "Maybe"', 2), ('Unexpected: "yes"', 1),
        ("Missing target value", 1), ("Total", 7),
    ]
    assert out[-1]["percent"] == 100.0
    assert sum(r["customer_count"] for r in out[:-1]) == 7


def test_status_table_empty(spark):
    out = rows(status_table(labels(spark, [])))
    assert [(r["status"], r["customer_count"], r["percent"]) for r in out] == [
        ("Retained", 0, 0.0), ("Churned", 0, 0.0), ("Total", 0, 100.0),
    ]


def test_numeric_segment_compares_as_text(spark):
    df = spark.createDataFrame([(1, "Yes"), (1, "No"), (2, "No"), (None, "Yes")], "Contract long, Churn string")
    out = rows(segment_rates(df, 50.0, expected=(1, 2, 3)))
    assert [(r["contract"], r["value_status"], r["customer_count"]) for r in out] == [
        ("1", "expected", 2), ("2", "expected", 1), ("3", "expected", 0), (None, "missing", 1),
    ]
