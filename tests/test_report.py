"""The quality report: equal to the single operators on any table, in two scans beside the duplicates' own."""

import json
import random

import pytest

from segstats.operators import quality
from segstats.operators.quality import Implication, QualityConfig
from segstats.sources.tables import load_table

SCHEMA = "id long, kind string, amount string, level double, score float"
CONFIG = QualityConfig(
    id_column="id",
    exclude_categorical=("amount",),
    rules=(Implication("none means zero", "kind", "none", ("amount", "level"), "0"), Implication("b", "kind", "b", ("level",), 1.0)),
    numeric_text_column="amount",
    minimums={"level": 0, "score": 0.5},
    domains={"kind": ("a", "b"), "score": (0.0, 1.0)},
    range_columns=("level", "id"),
    blank_context_column="score",
    contexts={"amount": ("id", "amount"), "level": ("level", "id"), "kind": ("id", "kind", "score")},
)


def table(spark, n, seed=3):
    r = random.Random(seed)
    data = [
        (
            r.choice([None, k]),
            r.choice(["a", "a", "a", "b", "none", "c", " ", "", None]),
            r.choice(["0", "1.5", " ", "", "x", None, "0"]),
            r.choice([-1.0, 0.0, -0.0, 1.0, float("nan"), None, float("inf")]),
            r.choice([0.0, -0.0, 0.25, 1.0, float("nan"), None]),
        )
        for k in range(n)
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def lines(df):
    return [tuple(r) for r in df.select("section", "item", "column_name", "value", "row_count", "metric").collect()]


@pytest.mark.parametrize("n", [0, 1, 400])
def test_report_equals_the_single_operators(spark, n):
    df = table(spark, n)
    got = lines(quality.quality_report(df, CONFIG))
    of = lambda section, *items: {g[1:] for g in got if g[0] == section and (not items or g[1] in items)}
    text = lambda frame: frame.collect()

    assert ("rows", None, None, n, None) in of("shape")
    missing = {("missing_values", r[0], None, r[2], r[3]) for r in text(quality.missing_by_column(df))}
    assert of("missing") == missing
    profile = {("value_count", r[0], r[1], r[2], r[3]) for r in text(quality.categorical_profile(df, exclude=("amount",)))}
    assert of("categorical_profile") == profile
    support = {(r[0], r[1], r[2], r[3], float(r[4])) for r in text(quality.implication_support(df, CONFIG.rules))}
    assert of("implication") == support
    broken = {(r[0], r[1], r[3], r[4], None) for r in text(quality.implication_violations(df, CONFIG.rules))}
    assert of("implication_violation") == broken
    readable = {(r[2], "amount", None, r[3], None) for r in text(quality.numeric_readability(df, "amount"))}
    assert of("readability", *quality.READABILITY_CLASSES) == readable
    blank = {("score", "amount", str(r[0]), r[1], None) for r in text(quality.class_context(df, "amount", "score"))}
    assert {(*b[:2], str(float(b[2])), *b[3:]) for b in of("blank_context")} == {(*b[:2], str(float(b[2]) + 0.0), *b[3:]) for b in blank}
    for col, minimum in CONFIG.minimums.items():
        r = quality.below_minimum(df, col, minimum).first()
        assert ("observed_min", col, None, None, r["observed_min"]) in of("below_minimum")
        assert ("below_count", col, None, r["below_count"], float(minimum)) in of("below_minimum")
        each = {(float(v), k) for v, k in quality.below_minimum_values(df, col, minimum).collect()}
        assert {(float(x[2]), x[3]) for x in of("below_minimum", "value_count") if x[1] == col} == each
    for col, allowed in CONFIG.domains.items():
        outside = quality.outside_domain_count(df, col, allowed).first()["outside_count"]
        assert ("outside_count", col, None, outside, None) in of("outside_domain")
        assert sum(x[3] for x in of("outside_domain", "value_count") if x[1] == col) == outside
    for col in CONFIG.range_columns:
        r = quality.range_profile(df, col).first()
        assert ("missing_count", col, None, r["missing_count"], None) in of("range")
        assert ("observed_min", col, None, None, r["observed_min"]) in of("range")
        assert ("observed_max", col, None, None, r["observed_max"]) in of("range")


def test_affected_records_are_the_first_ten_of_each_check(spark):
    df = table(spark, 400)
    records = [g for g in lines(quality.quality_report(df, CONFIG)) if g[1] == "affected_record"]
    data = df.collect()
    level = sorted(r["level"] for r in data if r["level"] is not None and r["level"] < 0)
    assert [json.loads(g[3])["level"] for g in records if g[2] == "level"] == level[:10]
    assert {g[4] for g in records if g[2] == "level"} == {len(level)}
    kind = sorted((r["id"] is not None, r["id"] or 0) for r in data if r["kind"] not in ("a", "b"))
    shown = sorted((x is not None, x or 0) for x in (json.loads(g[3])["id"] for g in records if g[2] == "kind"))
    assert shown == kind[:10]
    assert all(set(json.loads(g[3])) == {"id", "kind", "score"} for g in records if g[2] == "kind")


def test_all_sections_come_from_one_scan_and_all_samples_from_one(spark, monkeypatch):
    scans, names = [], ("count_duplicate_rows", "count_duplicate_ids")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    write = quality.materialize

    def counted(df):
        scans.append(plan(df).count("FileScan"))
        return write(df)

    monkeypatch.setattr(quality, "materialize", counted)
    for name in names:  # they have scans of their own
        one = spark.range(1).selectExpr(f"0L AS {name.removeprefix('count_')}")
        monkeypatch.setattr(quality, name, lambda *_, one=one: one)
    customer = load_table(spark, "/root/testdata/sf0.001", "customer")
    config = QualityConfig(
        id_column="c_custkey",
        minimums={"c_acctbal": 0},
        domains={"c_mktsegment": ("BUILDING",)},
        range_columns=("c_acctbal",),
        contexts={"c_acctbal": ("c_custkey", "c_acctbal"), "c_mktsegment": ("c_name", "c_mktsegment")},
    )
    report = quality.quality_report(customer, config)
    assert scans == [1]
    final = plan(report)
    assert final.count("FileScan") == 1
    assert final.count("WindowGroupLimit") >= 2  # tasks keep ten rows of a check before the exchange
