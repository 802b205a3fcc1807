"""The Bloom filter before exact joins (Q1, Q2) and text statistics by fingerprints."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from segstats.operators import bloom
from segstats.operators.quality import _text_statistics, count_duplicate_ids, count_duplicate_rows, describe_columns


@pytest.fixture
def no_broadcasts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("keys", [0, 1, 300, 5000])
def test_no_row_with_a_key_is_lost_and_few_others_pass(spark, keys):
    table = spark.range(40_000).select(F.xxhash64("id").alias("k"), "id")
    wanted = table.where(F.col("id") < keys).select("k")
    passed = {r["id"] for r in bloom.may_have(table, "k", wanted, keys).collect()}
    assert passed >= set(range(keys)) and len(passed) <= keys + 0.03 * 40_000


def test_a_filter_of_full_size_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 1)
    table = spark.range(20_000).select(F.xxhash64("id").alias("k"), "id")
    wanted = table.where(F.col("id") % 2 == 0).select("k")
    passed = {r["id"] for r in bloom.may_have(table, "k", wanted, 10_000).collect()}
    assert passed >= set(range(0, 20_000, 2))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_candidate_rows_are_exchanged(spark, no_broadcasts):
    """Between the scan and the first exchange stands the filter's lookup."""
    df = spark.createDataFrame([(f"text {i % 50 if i % 7 == 0 else i}", "x") for i in range(400)], "text string, other string")
    for got in (count_duplicate_rows(df), count_duplicate_ids(df, "text")):
        plan = plan_of(got)
        above = plan[: plan.index("_bloom_words")]
        assert "BroadcastHashJoin" in above
        scan = plan.index("Scan ExistingRDD[text")
        assert plan.rindex("Exchange hashpartitioning(_fp", 0, scan) < plan.index("_bloom_words") < scan
    counts = Counter(f"text {i % 50 if i % 7 == 0 else i}" for i in range(400))
    assert rows(count_duplicate_rows(df))[0]["duplicate_rows"] == sum(n - 1 for n in counts.values())


def test_no_exchange_holds_the_texts(spark, no_broadcasts):
    df = spark.createDataFrame([(f"a very long text {i % 9}",) for i in range(60)], "text string")
    plan = plan_of(_text_statistics(df, ["text"]))
    scan = plan.index("Scan ExistingRDD[text")
    assert plan.index("_bloom_words") < scan  # only candidates of the most frequent value go on
    above = [line for line in plan[:scan].splitlines() if "Exchange" in line]
    assert not any(re.search(r"hashpartitioning\((value|text)#", line) for line in above)


def plain_top(values):
    counts = Counter(v for v in values if v is not None)
    if not counts:
        return (0, 0, None, None)
    most = max(counts.values())
    return (sum(counts.values()), len(counts), min((v for v, n in counts.items() if n == most), key=str.encode), most)


@pytest.mark.parametrize("seed", range(3))
def test_text_statistics_are_exact(spark, seed):
    rng = random.Random(seed)
    spelt = ["", " ", "aaaaaaa", "aaaaaaab", "aaaaaaaa", "é", "日本語", "\x00", "a\x00", "z" * 500, "\U0001f600", "￿"]
    made = [
        (
            rng.choice(spelt),  # ties and shared leading bytes
            f"a common beginning {rng.randrange(10**6)}",  # nearly all different
            None,
            "hot" if rng.random() < 0.5 else rng.choice([None, "cold"]),
        )
        for _ in range(rng.choice([1, 30, 700]))
    ]
    df = spark.createDataFrame(made, "a string, b string, c string, d string")
    got = {r["column_name"]: (r["count"], r["unique"], r["top"], r["freq"]) for r in describe_columns(df).collect()}
    assert got == {c: plain_top([r[k] for r in made]) for k, c in enumerate("abcd")}
