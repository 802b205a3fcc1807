"""D1 and the shared refusals (R1): FIXTURES F1, F5."""

import math

import pytest

from conftest import rows
from segstats import distribution_by_label

SCHEMA = "tenure double, Churn string"
STATS = ["mean_tenure", "median_tenure", "q1_tenure", "q3_tenure", "iqr_tenure", "min_tenure", "max_tenure"]
COLUMNS = ["churn_status", "customer_count", "missing_tenure_count", "valid_tenure_count", *STATS]


def frame(spark, tenure, churn, schema=SCHEMA):
    if schema.startswith("tenure double"):
        tenure = [t if t is None else float(t) for t in tenure]
    return spark.createDataFrame(list(zip(tenure, churn)), schema)


def test_golden_table(spark):
    df = frame(spark, [0, 2, 4, 6, 8, None, 1, 3, 5, None], ["No"] * 6 + ["Yes"] * 4)
    out = distribution_by_label(df)
    assert out.columns == COLUMNS
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["string", "bigint", "bigint", "bigint"] + ["double"] * 7
    assert rows(out) == [
        dict(zip(COLUMNS, ["No", 6, 1, 5, 4.0, 4.0, 2.0, 6.0, 4.0, 0.0, 8.0])),
        dict(zip(COLUMNS, ["Yes", 4, 1, 3, 3.0, 3.0, 2.0, 4.0, 2.0, 1.0, 5.0])),
    ]


def test_interpolated_quartiles(spark):
    out = rows(distribution_by_label(frame(spark, [1, 3, 10, 20], ["No", "No", "Yes", "Yes"])))
    assert out[0]["mean_tenure"] == 2.0 and out[1]["mean_tenure"] == 15.0
    assert out[1]["iqr_tenure"] == 5.0


def test_missing_tenure_counted_not_filled(spark):
    out = rows(distribution_by_label(frame(spark, [10, 20, None], ["Yes"] * 3)))
    yes = out[1]
    assert (yes["customer_count"], yes["missing_tenure_count"], yes["valid_tenure_count"]) == (3, 1, 2)
    assert yes["mean_tenure"] == 15.0 and yes["min_tenure"] == 10.0
    assert out[0]["customer_count"] == 0


def test_zero_is_an_observation(spark):
    out = rows(distribution_by_label(frame(spark, [0, 0, 4], ["No", "Yes", "Yes"])))
    assert out[0]["valid_tenure_count"] == 1 and all(out[0][s] == 0.0 for s in STATS)
    assert out[1]["valid_tenure_count"] == 2 and out[1]["min_tenure"] == 0.0 and out[1]["mean_tenure"] == 2.0


def test_missing_label_in_neither_population(spark):
    out = rows(distribution_by_label(frame(spark, [1, 2, 99], ["No", "Yes", None])))
    assert sum(r["customer_count"] for r in out) == 2
    assert max(r["max_tenure"] for r in out) == 2.0


def test_empty_population_keeps_row(spark):
    out = rows(distribution_by_label(frame(spark, [1, 2], ["No", "No"])))
    assert out[1]["churn_status"] == "Yes" and out[1]["customer_count"] == 0
    assert all(out[1][s] is None for s in STATS)


def test_no_rows(spark):
    out = rows(distribution_by_label(spark.createDataFrame([], SCHEMA)))
    assert [r["churn_status"] for r in out] == ["No", "Yes"]
    assert all(r["customer_count"] == 0 and r["mean_tenure"] is None for r in out)


def test_nan_is_missing(spark):
    out = rows(distribution_by_label(frame(spark, [1.0, math.nan], ["No", "No"])))
    assert out[0]["missing_tenure_count"] == 1 and out[0]["mean_tenure"] == 1.0


def test_long_measure_gives_double_statistics(spark):
    out = distribution_by_label(frame(spark, [1, 2], ["No", "Yes"], "tenure bigint, Churn string"))
    assert out.schema["min_tenure"].dataType.simpleString() == "double"


def test_approx_method(spark):
    df = frame(spark, [0, 2, 4, 6, 8, None, 1, 3, 5, None], ["No"] * 6 + ["Yes"] * 4)
    out = rows(distribution_by_label(df, method="approx"))
    assert out[0]["median_tenure"] == 4.0


@pytest.mark.parametrize("drop", ["tenure", "Churn"])
def test_refuses_missing_column(spark, drop):
    df = frame(spark, [1], ["No"]).drop(drop)
    with pytest.raises(ValueError, match="Required column"):
        distribution_by_label(df)


@pytest.mark.parametrize("values", [["12", "8"], ["twelve", "eight"]])
def test_refuses_text_tenure(spark, values):
    df = frame(spark, values, ["No", "Yes"], "tenure string, Churn string")
    with pytest.raises(ValueError, match="numeric"):
        distribution_by_label(df)


def test_refuses_boolean_tenure(spark):
    df = frame(spark, [True, False], ["No", "Yes"], "tenure boolean, Churn string")
    with pytest.raises(ValueError, match="numeric"):
        distribution_by_label(df)


def test_empty_text_tenure_not_judged(spark):
    out = rows(distribution_by_label(spark.createDataFrame([], "tenure string, Churn string")))
    assert len(out) == 2


@pytest.mark.parametrize("label", ["Unknown", "yes", "1"])
def test_refuses_unexpected_label(spark, label):
    df = frame(spark, [1, 2], ["No", label])
    with pytest.raises(ValueError, match="outside"):
        distribution_by_label(df)


def test_refuses_integer_label_column(spark):
    df = frame(spark, [1, 2], [1, 0], "tenure double, Churn bigint")
    with pytest.raises(ValueError, match="outside"):
        distribution_by_label(df)


def test_input_unchanged(spark):
    df = frame(spark, [1, None], ["No", "Yes"])
    before = df.collect()
    distribution_by_label(df).collect()
    assert df.collect() == before
