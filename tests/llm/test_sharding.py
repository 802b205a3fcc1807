"""Sharding: a permutation at every row count, places that can be computed, odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from segstats.llm import sharding


def plain_place(x, n, seed):
    """The Feistel network with cycle walking, one number at a time."""
    m = sharding.side_of(n)
    left, right = divmod(x, m)
    while True:
        for k in range(sharding.ROUNDS):
            f = int(hashlib.md5(f"{seed}:{k}:{right}".encode()).hexdigest()[: sharding.DIGITS], 16)
            left, right = right, (left + f) % m
        if left * m + right < n:
            return left * m + right


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 17, 99, 1000, 4097])
def test_every_row_count_gets_a_permutation(spark, n):
    steps = sharding.walk_steps(spark, n, 42)
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 42, steps).alias("p"))
    back = sharding.row_number_at(F.pmod("p", F.lit(16)), F.expr("p div 16"), 16, n, 42, steps)
    got = rows.select("id", "p", back.alias("back")).collect()
    assert [r["p"] for r in got] == [plain_place(r["id"], n, 42) for r in got]
    assert sorted(r["p"] for r in got) == list(range(n))
    assert all(r["back"] == r["id"] for r in got)


def test_side_of():
    assert [sharding.side_of(n) for n in (0, 1, 2, 4, 5, 9, 10, 10**16, 10**16 + 1)] == [1, 1, 2, 2, 3, 3, 4, 10**8, 10**8 + 1]


def test_a_shuffle_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    found = []
    for parts in (1, 7):
        placed, number, shard, slot = sharding.with_shards(docs.repartition(parts), 8)
        found.append(sorted(tuple(r) for r in placed.select("doc_id", "text", number, shard, slot).collect()))
    assert found[0] == found[1] and [r[2] for r in found[0]] == list(range(500))
    other, number, shard, slot = sharding.with_shards(docs, 8, seed=7)
    assert sorted(tuple(r) for r in other.select("doc_id", "text", number, shard, slot).collect()) != found[0]


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(None, None, "a"), (None, "x", "b"), (3, "", "c"), (3, None, "d"), (3, "y", "e"), (3, "y", "e"), (4, "w " * 200_000, "f")]
    rows += [(9, "hot", "g")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("shard", "slot", "row_number", "_salt", "_at", "_place", "_range", "_first")})
    placed, number, shard, slot = sharding.with_shards(docs, 4)
    assert (number, shard, slot) == ("_row_number", "_shard", "_slot")
    got = placed.collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["other"]) for r in got) == sorted((str(a), str(b), c) for a, b, c in rows)
    assert all(r[c] == f"own {c}" for r in got for c in ("shard", "slot", "row_number", "_salt", "_at", "_place"))
    assert sorted(r[number] for r in got) == list(range(67))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r[number])][:7] == [None, None, 3, 3, 3, 3, 4]
    for k in range(4):
        slots = sorted(r[slot] for r in got if r[shard] == k)
        assert slots == list(range(len(slots))) and len(slots) in (16, 17)
    assert sharding.with_shards(docs.filter("false"), 4)[0].count() == 0
    few, _, shard, slot = sharding.with_shards(docs.limit(2), 16)
    assert sorted((r[shard], r[slot]) for r in few.collect()) == [(0, 0), (1, 0)]


def test_shards_are_written_in_slot_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 5)) for i in range(300)], "doc_id long, text string")
    placed, _, shard, slot = sharding.with_shards(docs, 3)
    folder = sharding.write_shards(placed, shard, slot, f"{tmp_path}/shards")
    back = spark.read.parquet(folder)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted((r["doc_id"], r["text"]) for r in docs.collect())
    for k in range(3):
        files = back.filter(F.col(shard) == k).groupBy(F.input_file_name()).agg(F.min(slot), F.max(slot), F.count(F.lit(1))).collect()
        spans = sorted((r[1], r[2], r[3]) for r in files)
        assert spans[0][0] == 0 and spans[-1][1] == 99 and all(b - a + 1 == n for a, b, n in spans)
