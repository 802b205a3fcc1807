"""Rows come out in the documented order on the driver tables."""

import pytest

from segstats.plans.registry import CUST_SEGMENTS, LI_SEGMENTS, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def collected(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


@pytest.mark.parametrize("name,key", [("rate_by_value_cust", "tenure_month"), ("rate_by_value_li", "quantity")])
def test_rates_ascend_by_value(spark, name, key):
    values = [r[key] for r in collected(spark, name)]
    assert values == sorted(values) and len(values) > 10


@pytest.mark.parametrize(
    "name,segment,expected", [("segment_rates_cust", "contract", CUST_SEGMENTS), ("segment_rates_li", "linestatus", LI_SEGMENTS)]
)
def test_segments_expected_unexpected_missing(spark, name, segment, expected):
    rows = collected(spark, name)
    rank = {"expected": 0, "unexpected": 1, "missing": 2}

    def key(r):
        place = expected.index(r[segment]) if r["value_status"] == "expected" else 0
        return rank[r["value_status"]], place, -r["customer_count"], r[segment] or ""

    assert rows == sorted(rows, key=key)
    assert [r[segment] for r in rows[: len(expected)]] == list(expected)


@pytest.mark.parametrize(
    "name,columns",
    [
        ("categorical_profile_orders", ["o_orderstatus", "o_orderpriority"]),
        ("categorical_profile_lineitem", ["l_returnflag", "l_linestatus"]),
    ],
)
def test_profile_by_column_then_count(spark, name, columns):
    rows = collected(spark, name)
    present = list(dict.fromkeys(r["column_name"] for r in rows))
    assert present == [c for c in columns if c in present]
    assert rows == sorted(rows, key=lambda r: (present.index(r["column_name"]), -r["value_count"], r["value"] is None, r["value"] or ""))


def test_status_table_order(spark):
    status = [r["status"] for r in collected(spark, "status_table")]
    assert status[:2] == ["Retained", "Churned"] and status[-1] == "Total"
    assert status[2:-1] == ['Unexpected: "Unknown"', "Missing target value"]
