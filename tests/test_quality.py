"""FIXTURES F6."""

import pandas as pd
import pytest

from conftest import rows
from segstats import (
    Implication,
    QualityConfig,
    below_minimum,
    below_minimum_values,
    categorical_columns,
    categorical_profile,
    class_context,
    count_duplicate_ids,
    count_duplicate_rows,
    describe_columns,
    domain_conformance,
    implication_support,
    implication_violations,
    missing_by_column,
    numeric_readability,
    outside_domain,
    outside_domain_count,
    product_residual,
    quality_report,
    range_profile,
    readability_sample,
    schema_profile,
    table_shape,
)
from segstats.functions import is_blank, numeric_value


def test_duplicates(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3), (None, 4), ("c", None), ("c", None)], "id string, a long"
    )
    assert rows(count_duplicate_rows(df))[0]["duplicate_rows"] == 3
    assert rows(count_duplicate_ids(df, "id"))[0]["duplicate_ids"] == 4  # a, two NULL repeats, c
    assert rows(count_duplicate_rows(df, ["a"]))[0]["duplicate_rows"] == 3


def test_duplicates_none(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, a long")
    assert rows(count_duplicate_rows(df))[0]["duplicate_rows"] == 0
    assert rows(count_duplicate_rows(spark.createDataFrame([], "id string")))[0]["duplicate_rows"] == 0


def test_duplicates_match_pandas(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.integers(0, 5, 300), "y": rng.choice(["p", "q", None], 300)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "x long, y string")
    assert rows(count_duplicate_rows(df))[0]["duplicate_rows"] == int(pdf.duplicated().sum())


TELCO = "customerID string, tenure long, SeniorCitizen long, MonthlyCharges double, TotalCharges string, Churn string"


def telco(spark):
    return spark.createDataFrame(
        [
            ("A", 1, 0, 20.0, "20.0", "No"),
            ("B", 0, 1, 30.0, " ", "Yes"),
            ("C", None, 2, None, None, None),
            ("D", -1, None, 45.5, "abc", ""),
            ("E", 12, 0, 10.0, "120.0", "No"),
        ],
        TELCO,
    )


def test_missing_by_column_blank_is_present(spark):
    out = {r["column_name"]: r for r in rows(missing_by_column(telco(spark)))}
    assert out["Churn"]["missing_count"] == 1 and out["TotalCharges"]["missing_count"] == 1
    assert out["tenure"]["missing_percent"] == pytest.approx(20.0)


def test_shape_and_schema(spark):
    assert rows(table_shape(telco(spark)))[0] == {"row_count": 5, "column_count": 6}
    prof = rows(schema_profile(telco(spark)))
    assert [(r["column_name"], r["data_type"], r["non_null_count"]) for r in prof][:3] == [
        ("customerID", "string", 5), ("tenure", "bigint", 4), ("SeniorCitizen", "bigint", 4),
    ]


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 10.0, None], "b": ["x", "y", "x", None, "y"]})
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "x"), (10.0, None), (None, "y")], "a double, b string")
    out = {r["column_name"]: r for r in rows(describe_columns(df))}
    d = pdf.describe(include="all")
    for stat, col in [("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "p25"), ("50%", "p50"), ("75%", "p75"), ("max", "max")]:
        assert out["a"][col] == pytest.approx(d.loc[stat, "a"])
    assert out["a"]["count"] == 4
    assert (out["b"]["count"], out["b"]["unique"], out["b"]["top"], out["b"]["freq"]) == (4, 2, "x", 2)


def test_categorical_profile(spark):
    df = telco(spark)
    assert categorical_columns(df, exclude=("customerID", "TotalCharges")) == ["Churn"]
    out = rows(categorical_profile(df, exclude=("customerID", "TotalCharges")))
    assert [(r["value"], r["value_count"]) for r in out] == [("No", 2), ("", 1), ("Yes", 1), (None, 1)]
    assert sum(r["value_percent"] for r in out) == pytest.approx(100.0)


RULE = Implication("no_internet", "InternetService", "No", ("OnlineSecurity", "TechSupport"), "No internet service")
SVC = "InternetService string, OnlineSecurity string, TechSupport string"


def services(spark):
    return spark.createDataFrame(
        [
            ("No", "No internet service", "No internet service"),
            ("No", "Yes", "No internet service"),
            ("No", None, "No internet service"),
            ("DSL", "No internet service", "Yes"),  # converse departure: not reported
            (None, "Yes", "Yes"),
        ],
        SVC,
    )


def test_implication_violations(spark):
    out = rows(implication_violations(services(spark), [RULE]))
    assert [(r["column_name"], r["observed_value"], r["affected_rows"]) for r in out] == [
        ("OnlineSecurity", "Yes", 1), ("OnlineSecurity", None, 1),
    ]


def test_implication_support(spark):
    r = rows(implication_support(services(spark), [RULE]))[0]
    assert (r["trigger_rows"], r["violating_rows"], r["holds"]) == (3, 2, False)


BLANKS = [None, "", " ", "\t", " ", "　", "12.5", " 12 ", "1d", "nan", "inf", "1,000", "abc", "-inf", ".5", "5.", "1e3", "0x10", "+5"]


def test_blank_and_numeric_match_pandas(spark):
    df = spark.createDataFrame([(v,) for v in BLANKS], "t string")
    got = df.select(is_blank(df["t"]).alias("b"), numeric_value(df["t"]).alias("n")).collect()
    s = pd.Series(BLANKS, dtype=object)
    blank = (s.notna() & (s.astype(str).str.strip() == "")).tolist()
    num = pd.to_numeric(s, errors="coerce")
    assert [r["b"] for r in got] == blank
    for r, expected in zip(got, num.tolist()):
        assert (r["n"] is None) == pd.isna(expected)
        if r["n"] is not None:
            assert r["n"] == expected


def test_numeric_readability(spark):
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(BLANKS)], "TotalCharges string, tenure long")
    out = {r["value_class"]: r["row_count"] for r in rows(numeric_readability(df, "TotalCharges"))}
    assert out == {"missing": 1, "blank": 5, "non_numeric": 5, "convertible": 8}
    ctx = rows(class_context(df, "TotalCharges", "tenure"))
    assert sum(r["row_count"] for r in ctx) == 5
    sample = rows(readability_sample(df, "TotalCharges", ["TotalCharges", "tenure"], ["TotalCharges"], n=3))
    assert len(sample) == 3 and all(r["affected_count"] == 11 for r in sample)


def test_numeric_checks(spark):
    df = telco(spark)
    r = rows(below_minimum(df, "tenure", 0))[0]
    assert (r["observed_min"], r["below_count"]) == (-1.0, 1)
    assert rows(below_minimum_values(df, "tenure", 0)) == [{"tenure": -1, "row_count": 1}]
    dom = {r["SeniorCitizen"]: (r["row_count"], r["in_domain"]) for r in rows(outside_domain(df, "SeniorCitizen", (0, 1)))}
    assert dom == {0: (2, True), 1: (1, True), 2: (1, False), None: (1, False)}
    assert rows(outside_domain_count(df, "SeniorCitizen", (0, 1)))[0]["outside_count"] == 2
    p = rows(range_profile(df, "MonthlyCharges"))[0]
    assert (p["missing_count"], p["observed_min"], p["observed_max"]) == (1, 10.0, 45.5)


def test_domain_conformance(spark):
    out = rows(domain_conformance(telco(spark), {"Churn": ("Yes", "No"), "SeniorCitizen": (0, 1)}))
    assert [(r["column_name"], r["value"], r["value_status"], r["row_count"]) for r in out] == [
        ("Churn", "", "unexpected", 1), ("Churn", None, "missing", 1),
        ("SeniorCitizen", "2", "unexpected", 1), ("SeniorCitizen", None, "missing", 1),
    ]


def test_product_residual(spark):
    df = spark.createDataFrame(
        [("20.0", 1, 20.0), ("31.0", 3, 10.0), ("29.0", 3, 10.0), (" ", 0, 5.0), ("30.004", 3, 10.0)],
        "TotalCharges string, tenure long, MonthlyCharges double",
    )
    r = rows(product_residual(df, "TotalCharges", "tenure", "MonthlyCharges"))[0]
    assert (r["convertible_count"], r["zero_difference_count"], r["nonzero_difference_count"]) == (4, 2, 2)
    assert (r["min_difference"], r["max_difference"]) == pytest.approx((-1.0, 1.0))


def test_quality_report(spark):
    cfg = QualityConfig(
        id_column="customerID",
        exclude_categorical=("customerID", "TotalCharges"),
        numeric_text_column="TotalCharges",
        minimums={"tenure": 0},
        domains={"SeniorCitizen": (0, 1)},
        range_columns=("MonthlyCharges",),
    )
    out = rows(quality_report(telco(spark), cfg))
    by = {(r["section"], r["item"], r["column_name"], r["value"]): r for r in out}
    assert by[("shape", "rows", None, None)]["row_count"] == 5
    assert by[("readability", "blank", "TotalCharges", None)]["row_count"] == 1
    assert by[("below_minimum", "below_count", "tenure", None)]["row_count"] == 1
    assert by[("outside_domain", "outside_count", "SeniorCitizen", None)]["row_count"] == 2
    assert by[("duplicates", "duplicate_ids", "customerID", None)]["row_count"] == 0


def test_describe_approx_and_empty_numeric(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    out = {r["column_name"]: r for r in rows(describe_columns(df, method="approx"))}
    assert out["a"]["p50"] in (1.0, 3.0) and out["a"]["count"] == 2
    exact = {r["column_name"]: r for r in rows(describe_columns(df))}
    assert exact["a"]["p50"] == 2.0
    assert exact["b"]["count"] == 0 and exact["b"]["p50"] is None and exact["b"]["mean"] is None
