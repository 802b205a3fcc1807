"""Invariants on the driver tables (sf0.001): partitions add up, bins cover, whiskers stay inside fences."""

import pytest

from conftest import rows
from segstats import (
    box_plot_stats,
    histogram_by_label,
    numeric_readability,
    observed_range,
    rate_by_value,
    reconcile_slice,
    segment_rates,
    slice_vs_baseline,
    status_table,
)
from segstats.plans import bindings as B

SF = "/root/testdata/sf0.001"


def test_segment_rows_partition_the_table(spark):
    li = B.li(spark, SF)
    out = rows(segment_rates(li, 30.0, segment="l_returnflag", expected=("A", "N"), label="returned"))
    assert sum(r["customer_count"] for r in out) == li.count()
    assert {r["value_status"] for r in out} == {"expected", "unexpected"}


def test_status_rows_add_up_to_total(spark):
    out = rows(status_table(B.cust_unknown(spark, SF)))
    assert out[-1]["status"] == "Total"
    assert sum(r["customer_count"] for r in out[:-1]) == out[-1]["customer_count"]
    assert sum(r["percent"] for r in out[:-1]) == pytest.approx(100.0)


def test_readability_classes_partition_rows(spark):
    ch = B.charges(spark, SF)
    assert sum(r["row_count"] for r in rows(numeric_readability(ch, "TotalCharges"))) == ch.count()


@pytest.mark.parametrize("bounds", [(0, 6), (0, 60), (10, 40)])
def test_values_reconcile_with_slice(spark, bounds):
    cust = B.cust(spark, SF)
    r = rows(reconcile_slice(rate_by_value(cust), slice_vs_baseline(cust, *bounds)))[0]
    assert r["reconciles"] is True


def test_histogram_covers_every_observation(spark):
    cust = B.cust(spark, SF)
    n = {r["churn_status"]: r["observation_count"] for r in rows(observed_range(cust))}
    hist = rows(histogram_by_label(cust))
    for status, count in n.items():
        assert sum(r["observation_count"] for r in hist if r["churn_status"] == status) == count


def test_whiskers_inside_fences(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    for r in rows(box_plot_stats(e, measure="value", label="event_type", populations=("click", "error", "view"))):
        assert r["q1"] - 1.5 * r["iqr"] <= r["lower_whisker"] <= r["q1"]
        assert r["q3"] <= r["upper_whisker"] <= r["q3"] + 1.5 * r["iqr"]
