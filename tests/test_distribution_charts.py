"""FIXTURES F6 (the reference has no tests for the chart data)."""

import numpy as np
import pytest

from conftest import rows
from segstats import (
    box_plot_fliers,
    box_plot_stats,
    histogram_by_label,
    observed_range,
    population_observations,
    shared_bin_edges,
)

SCHEMA = "tenure double, Churn string"


def frame(spark, tenure, churn):
    tenure = [t if t is None else float(t) for t in tenure]
    return spark.createDataFrame(list(zip(tenure, churn)), SCHEMA)


def edges(df, **kw):
    return [r["edge"] for r in rows(shared_bin_edges(df, **kw))]


def test_population_observations_drop_missing_and_other_labels(spark):
    df = frame(spark, [1, None, 3, 4], ["No", "Yes", None, "Yes"])
    assert sorted((r["churn_status"], r["tenure"]) for r in rows(population_observations(df))) == [("No", 1.0), ("Yes", 4.0)]


def test_observed_range(spark):
    out = rows(observed_range(frame(spark, [1, 5, 3, None], ["No", "No", "Yes", "Yes"])))
    assert [(r["churn_status"], r["observation_count"]) for r in out] == [("No", 2), ("Yes", 1)]
    assert all(r["range_min"] == 1.0 and r["range_max"] == 5.0 for r in out)


def test_bin_edges_full_range(spark):
    df = frame(spark, list(range(73)), ["No", "Yes"] * 36 + ["No"])
    assert edges(df) == [float(x) for x in range(0, 73, 6)]


def test_bin_edges_negative_and_single_value(spark):
    assert edges(frame(spark, [-1, 0], ["No", "Yes"])) == [-6.0, 0.0]
    assert edges(frame(spark, [0], ["No"])) == [0.0, 6.0]


def test_bin_edges_no_observation(spark):
    assert edges(spark.createDataFrame([], SCHEMA)) == [0.0, 6.0]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    no, yes = rng.integers(0, 73, 200), rng.integers(0, 40, 100)
    df = frame(spark, [float(x) for x in [*no, *yes]], ["No"] * 200 + ["Yes"] * 100)
    bins = edges(df)
    out = rows(histogram_by_label(df))
    for label, values in (("No", no), ("Yes", yes)):
        expected, _ = np.histogram(values, bins=bins)
        got = [r["observation_count"] for r in out if r["churn_status"] == label]
        assert got == list(expected)
        assert all(r["population_count"] == len(values) for r in out if r["churn_status"] == label)


def test_histogram_empty_population_has_zero_bins(spark):
    out = rows(histogram_by_label(frame(spark, [0, 72], ["No", "No"])))
    yes = [r for r in out if r["churn_status"] == "Yes"]
    assert len(yes) == 12 and all(r["observation_count"] == 0 for r in yes)


def test_histogram_refuses_bad_width(spark):
    with pytest.raises(ValueError):
        histogram_by_label(frame(spark, [1], ["No"]), width=0)


def mpl_stats(x, whis=1.5):
    """The whisker rule of the usual box-plot statistics, computed by hand."""
    x = np.asarray(x, dtype=float)
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    lo_in = x[x >= q1 - whis * iqr]
    hi_in = x[x <= q3 + whis * iqr]
    wlo = q1 if len(lo_in) == 0 or lo_in.min() > q1 else lo_in.min()
    whi = q3 if len(hi_in) == 0 or hi_in.max() < q3 else hi_in.max()
    fliers = x[(x < wlo) | (x > whi)]
    return q1, med, q3, wlo, whi, sorted(fliers.tolist())


@pytest.mark.parametrize(
    "values",
    [
        [1, 2, 3, 4, 5, 6, 7, 8, 100],
        [0, 10, 10, 10, 10, 10, 10, 11],
        [5, 5, 5, 5],
        [-50, 1, 2, 3, 4, 5, 60, 61],
    ],
)
def test_box_plot_matches_reference_rule(spark, values):
    df = frame(spark, [float(v) for v in values] + [1.0, 2.0], ["No"] * len(values) + ["Yes", "Yes"])
    stats = [r for r in rows(box_plot_stats(df)) if r["churn_status"] == "No"][0]
    q1, med, q3, wlo, whi, fliers = mpl_stats(values)
    assert (stats["q1"], stats["median"], stats["q3"]) == pytest.approx((q1, med, q3))
    assert (stats["lower_whisker"], stats["upper_whisker"]) == pytest.approx((wlo, whi))
    assert stats["flier_count"] == len(fliers)
    got = sorted(r["tenure"] for r in rows(box_plot_fliers(df)) if r["churn_status"] == "No")
    assert got == fliers


def test_box_plot_empty_population(spark):
    out = rows(box_plot_stats(frame(spark, [1, 2, 3], ["No"] * 3)))
    yes = out[1]
    assert yes["churn_status"] == "Yes" and yes["n"] == 0 and yes["q1"] is None and yes["flier_count"] == 0


def test_histogram_fractional_width_matches_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(10, 4, 400), 2)
    df = frame(spark, [float(v) for v in values], ["No"] * 400)
    edges_ = edges(df, width=2.5)
    lo = np.floor(values.min() / 2.5) * 2.5
    assert edges_[0] == lo and edges_[-1] >= values.max()
    expected, _ = np.histogram(values, bins=edges_)
    got = [r["observation_count"] for r in rows(histogram_by_label(df, width=2.5)) if r["churn_status"] == "No"]
    assert got == list(expected)
