"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions alone.

Rows are numbered from 0 in an order that their contents decide. A Feistel
network permutes the pairs (left, right) of numbers below ``m = ceil(sqrt(n))``,
that is the numbers below ``m * m``; a number that leaves the table's ``n`` rows is
permuted again until it is back (cycle walking), which makes it a permutation
of the n rows. The permuted number modulo the shard count is the shard, divided
by it the slot. Both follow from the row number, the row count and the seed, and
``row_number_at`` goes back from shard and slot, so nothing needs to be looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.llm.common import fresh_name, numbered, text_of
from segstats.session import shared_dir

ROUNDS = 6
#: Hex digits of a round's md5 that are used.
DIGITS = 12


def _round(seed: int, k: Column, half: Column, m: int) -> Column:
    """The round function: md5 of seed, round and half, as a number below ``m``."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string"), half.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long"), F.lit(m))


def _halves(x: Column, m: int) -> Column:
    return F.struct(
        F.call_function("div", x, F.lit(m)).cast("long").alias("left"), F.pmod(x, F.lit(m)).cast("long").alias("right")
    )


def _joined(h: Column, m: int) -> Column:
    return h["left"] * F.lit(m) + h["right"]


def feistel(x: Column, m: int, seed: int) -> Column:
    """The permutation of the numbers below ``m * m``."""

    def step(h: Column, k: Column) -> Column:
        mixed = F.pmod(h["left"] + _round(seed, k, h["right"], m), F.lit(m))
        return F.struct(h["right"].alias("left"), mixed.cast("long").alias("right"))

    rounds = F.array(*[F.lit(k) for k in range(ROUNDS)])
    return F.aggregate(rounds, _halves(x, m), step, lambda h: _joined(h, m))


def unfeistel(x: Column, m: int, seed: int) -> Column:
    """The inverse of ``feistel``."""

    def step(h: Column, k: Column) -> Column:
        mixed = F.pmod(h["right"] - _round(seed, k, h["left"], m), F.lit(m))
        return F.struct(mixed.cast("long").alias("left"), h["left"].alias("right"))

    rounds = F.array(*[F.lit(k) for k in reversed(range(ROUNDS))])
    return F.aggregate(rounds, _halves(x, m), step, lambda h: _joined(h, m))


def side_of(n: int) -> int:
    """The least m with ``m * m >= n``, 1 at least."""
    return max(1, math.isqrt(max(n, 1) - 1) + 1)


def walk_steps(spark: SparkSession, n: int, seed: int) -> int:
    """The most times that any of ``n`` rows is permuted again before its number is below ``n``.

    Only numbers from n to m * m (about 2 sqrt(n) of them) lengthen a walk.
    Those that a row enters by are followed in a small Spark job until all are back.
    """
    m = side_of(n)
    outside = spark.range(n, m * m).filter(unfeistel(F.col("id"), m, seed) < n)
    steps = 0
    while not outside.isEmpty():
        steps += 1
        outside = outside.select(feistel(F.col("id"), m, seed).alias("id")).filter(F.col("id") >= n)
    return steps


def permuted(number: Column, n: int, seed: int, steps: int) -> Column:
    """Row number -> place in the shuffle, both below ``n``."""
    m = side_of(n)
    walk = F.array_repeat(F.lit(0), steps)
    return F.aggregate(
        walk, feistel(number, m, seed), lambda x, _: F.when(x >= n, feistel(x, m, seed)).otherwise(x)
    )


def row_number_at(shard: Column, slot: Column, shards: int, n: int, seed: int, steps: int) -> Column:
    """The number of the row at a shard and slot."""
    m = side_of(n)
    walk = F.array_repeat(F.lit(0), steps)
    place = slot.cast("long") * shards + shard
    return F.aggregate(
        walk, unfeistel(place, m, seed), lambda x, _: F.when(x >= n, unfeistel(x, m, seed)).otherwise(x)
    )


def with_shards(
    docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, str, str, str]:
    """``docs`` with each row's number, shard and slot, and those columns' names.

    Rows are numbered by id (null first), then by the hash of their text; rows
    equal in both are numbered in any order, those equal in all columns can't
    be told apart anyway. Shards hold equal numbers of rows but for one; slots
    go from 0 without gap in each. A null text is like an empty one here and
    stays null. Texts move once and are never looked into; all rows and
    columns stay, and a clashing name gets underscores in front. An empty table
    gives an empty one; shards beyond the row count stay empty.
    """
    number = fresh_name("row_number", docs.columns)
    shard = fresh_name("shard", docs.columns)
    slot = fresh_name("slot", docs.columns)
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_of(text_col))]
    rows, n = numbered(docs, order, number, "sharded-rows")
    place = fresh_name("_place", rows.columns)
    steps = walk_steps(docs.sparkSession, n, seed)
    placed = rows.withColumn(place, permuted(F.col(number), n, seed, steps))
    return (
        placed.withColumns(
            {
                shard: F.pmod(place, F.lit(shards)).cast("int"),
                slot: F.call_function("div", F.col(place), F.lit(shards)).cast("long"),
            }
        ).drop(place),
        number,
        shard,
        slot,
    )


def write_shards(sharded: DataFrame, shard: str, slot: str, folder: str | None = None) -> str:
    """Parquet files below ``shard=.../``, the rows of each in slot order, and their folder.

    Tasks take ranges of (shard, slot), so a shard of any size is written by
    several tasks, in files whose slots follow one another.
    """
    folder = folder or shared_dir(sharded.sparkSession, "shards")
    ranged = sharded.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    ranged.write.partitionBy(shard).option("compression", "zstd").parquet(folder)
    return folder
