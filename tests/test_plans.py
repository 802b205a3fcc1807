"""Physical-plan properties: pruning, pushdown, no joins where none are needed."""

from segstats import below_minimum_values, categorical_profile, implication_violations, population_observations, segment_rates
from segstats.operators import dist, quality, segments
from segstats.operators.quality import Implication
from segstats.sources.tables import load_table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_segment_rates_prunes_columns_and_needs_no_join(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = plan(segment_rates(li, 30.0, segment="l_linestatus", expected=("O", "F"), label="l_returnflag", positive="R"))
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in p
    assert "Join" not in p
    assert "partial_sum" in p  # map-side partial aggregation before the shuffle


def test_profile_is_one_aggregation_without_join(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    p = plan(categorical_profile(o, exclude=("o_orderdate",)))
    assert "Expand" in p and "Join" not in p
    assert "o_totalprice" not in p.split("ReadSchema")[1].split("\n")[0]


def test_violations_push_trigger_filter(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    rule = Implication("r", "l_linestatus", "F", ("l_returnflag",), "R")
    p = plan(implication_violations(li, [rule]))
    assert "PushedFilters: [" in p and "EqualTo(l_linestatus,F)" in p


def test_below_minimum_pushes_comparison(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    assert "LessThan(c_acctbal,0.0)" in plan(below_minimum_values(c, "c_acctbal", 0))


def test_observations_push_not_null_and_label(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    p = plan(population_observations(e, measure="value", label="event_type", populations=("click", "view")))
    assert "IsNotNull(value)" in p and "In(event_type" in p


def executed(df):
    """The physical plan after a run, with the exchanges that were reused."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan_serves_counts_and_total(spark):
    li = load_table(spark, SF, "lineitem")
    profile = quality.categorical_profile(li, columns=["l_returnflag", "l_linestatus"])
    assert "ReusedExchange" in executed(profile) or "ReusedSubquery" in executed(profile)
    status = segments.status_table(li, label="l_returnflag", positive="R", negative="N")
    assert "ReusedExchange" in executed(status) or "ReusedSubquery" in executed(status)


def test_fliers_are_filtered_not_generated(spark):
    ev = load_table(spark, SF, "events")
    fliers = dist.box_plot_fliers(ev, measure="value", label="event_type", populations=("click", "view"))
    assert "Generate" not in executed(fliers)


def test_duplicate_check_hints_its_bounded_filter_only(spark):
    """The join with the repeated fingerprints is left to their measured size; the Bloom filter has a size bound."""
    plan = quality.count_duplicate_rows(load_table(spark, SF, "lineitem"))._jdf.queryExecution().logical().toString()
    lines = plan.splitlines()
    hinted = [k for k, line in enumerate(lines) if "Hint" in line]
    assert len(hinted) == 1 and "_bloom_words" in lines[hinted[0] + 1]
    joins = [line for line in lines if "Join" in line]
    assert len(joins) == 2 and "_fp" in joins[0] and "_bloom_block" in joins[1]
