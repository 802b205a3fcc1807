"""The telco preset end to end on a frame with the 21 documented columns."""

from conftest import rows
from segstats import (
    distribution_by_label,
    domain_conformance,
    quality_report,
    rate_by_value,
    segment_rates,
    slice_vs_baseline,
    status_table,
)
from segstats.plans.presets import TELCO_DOMAINS, TELCO_QUALITY

COLUMNS = (
    "customerID string, gender string, SeniorCitizen long, Partner string, Dependents string, tenure long, "
    "PhoneService string, MultipleLines string, InternetService string, OnlineSecurity string, OnlineBackup string, "
    "DeviceProtection string, TechSupport string, StreamingTV string, StreamingMovies string, Contract string, "
    "PaperlessBilling string, PaymentMethod string, MonthlyCharges double, TotalCharges string, Churn string"
)
NI = "No internet service"


def telco(spark):
    data = [
        ("0001-A", "Female", 0, "Yes", "No", 1, "No", "No phone service", "DSL", "No", "Yes", "No", "No", "No", "No",
         "Month-to-month", "Yes", "Electronic check", 29.85, "29.85", "No"),
        ("0002-B", "Male", 0, "No", "No", 34, "Yes", "No", "No", NI, NI, NI, NI, NI, NI,
         "One year", "No", "Mailed check", 20.0, "680.0", "No"),
        ("0003-C", "Male", 1, "No", "No", 2, "Yes", "No", "No", "Yes", NI, NI, NI, NI, NI,
         "Month-to-month", "Yes", "Mailed check", 53.85, "108.15", "Yes"),
        ("0004-D", "Female", 0, "No", "No", 0, "No", "Yes", "Fiber optic", "No", "No", "Yes", "No", "Yes", "Yes",
         "Two year", "Yes", "Bank transfer (automatic)", 70.7, " ", "No"),
        ("0004-D", "Female", 2, "No", "No", 45, "Yes", "Yes", "Fiber optic", "No", "No", "Yes", "No", "Yes", "Yes",
         "Weekly", "Yes", "Credit card (automatic)", 99.65, "4484.25", "Yes"),
    ]
    return spark.createDataFrame(data, COLUMNS)


def test_analyses_with_default_roles(spark):
    df = telco(spark)
    assert [r["tenure_month"] for r in rows(rate_by_value(df))] == [0, 1, 2, 34, 45]
    r = rows(slice_vs_baseline(df))[0]
    assert (r["slice_customer_count"], r["slice_churned_count"]) == (3, 1)
    assert [r["customer_count"] for r in rows(distribution_by_label(df))] == [3, 2]
    seg = rows(segment_rates(df, 40.0))
    assert [(r["contract"], r["value_status"]) for r in seg] == [
        ("Month-to-month", "expected"), ("One year", "expected"), ("Two year", "expected"), ("Weekly", "unexpected"),
    ]
    assert [r["status"] for r in rows(status_table(df))] == ["Retained", "Churned", "Total"]


def test_quality_report_with_preset(spark):
    out = rows(quality_report(telco(spark), TELCO_QUALITY))
    by = {(r["section"], r["item"], r["column_name"], r["value"]): r["row_count"] for r in out}
    assert by[("duplicates", "duplicate_ids", "customerID", None)] == 1
    assert by[("readability", "blank", "TotalCharges", None)] == 1
    assert by[("outside_domain", "outside_count", "SeniorCitizen", None)] == 1
    assert by[("implication", "no_internet_service", "InternetService", "No")] == 2
    assert by[("implication_violation", "no_internet_service", "OnlineSecurity", "Yes")] == 1
    assert by[("implication", "no_phone_service", "PhoneService", "No")] == 2
    assert by[("implication_violation", "no_phone_service", "MultipleLines", "Yes")] == 1


def test_documented_domains(spark):
    out = rows(domain_conformance(telco(spark), TELCO_DOMAINS))
    assert [(r["column_name"], r["value"]) for r in out] == [("Contract", "Weekly")]
