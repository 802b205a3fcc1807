"""What refusals say, where intermediates go, and histograms without a bar limit."""

import os
from types import SimpleNamespace

import pytest

from conftest import rows
from segstats.operators import dist, segments
from segstats.session import shared_dir


def test_quoted_labels_tell_how_many_there_are(spark):
    df = spark.createDataFrame([(1, f"v{k:02d}") for k in range(25)], "tenure bigint, Churn string")
    with pytest.raises(ValueError, match="10 of 25 distinct"):
        segments.rate_by_value(df)
    with pytest.raises(ValueError, match=r"\('v00', 'v01'\)"):
        dist.distribution_by_label(df.limit(2).where("Churn < 'v02'"))


def test_many_bars(spark):
    df = spark.createDataFrame([(0.0, "No"), (3e6, "Yes")], "tenure double, Churn string")
    assert dist.shared_bin_edges(df, width=1).count() == 3_000_001
    bars = dist.histogram_by_label(df, width=1)
    assert bars.count() == 6_000_000
    assert rows(bars.groupBy().sum("observation_count")) == [{"sum(observation_count)": 2}]


def test_wide_range_beyond_an_int(spark):
    df = spark.createDataFrame([(0.0, "No"), (3e10, "Yes")], "tenure double, Churn string")
    last = dist.shared_bin_edges(df, width=1e7).orderBy("edge_index", ascending=False).first()
    assert tuple(last) == (3000, 3e10)


def test_infinite_range_is_refused_alike(spark):
    df = spark.createDataFrame([(0.0, "No"), (float("inf"), "Yes")], "tenure double, Churn string")
    for make in (dist.shared_bin_edges, dist.histogram_by_label):
        with pytest.raises(ValueError, match="infinite"):
            make(df)


def test_a_session_without_checkpoint_folder_is_told_so():
    unset = SimpleNamespace(
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None),
        conf=SimpleNamespace(get=lambda key, default: default),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(unset, "x")


def test_repeated_calls_leave_no_files(spark):
    import gc
    import time

    df = spark.createDataFrame([(k % 7, "Yes" if k % 2 else "No") for k in range(50)], "tenure bigint, Churn string")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def files():
        return sum(len(names) for _, _, names in os.walk(folder))

    before = files()
    for _ in range(5):
        dist.distribution_by_label(df).collect()
        dist.box_plot_stats(df).collect()
        dist.histogram_by_label(df).collect()
        segments.rate_by_value(df).collect()
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if files() <= before:
            break
        time.sleep(0.5)
    assert files() <= before
