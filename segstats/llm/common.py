"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segstats.session import shared_dir

PACKAGE_PARENT = str(Path(__file__).resolve().parents[2])


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers that share this machine's files import this package.

    On a cluster the package is shipped as usual (``--py-files`` or an
    installed wheel) and the extra path entry is simply absent there.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_PARENT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_PARENT, *parts])


def write_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read back.

    Every executor can read the files, so a lost executor costs only its
    running tasks; lineage is cut here.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(base: str, taken: list[str]) -> str:
    """``base``, or ``base`` with underscores in front until no column has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = f"_{base}"
    return base


def text_of(column: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def prefix_sums(totals: DataFrame, key: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """``totals`` (one row per integer ``key``) with ``out``: the sum of ``value`` over smaller keys.

    Two levels, so no window sees more than ``block`` rows or one row per
    block: sums within a block of keys, then sums over whole blocks.
    """
    totals = totals.withColumn("_block", F.floor(F.col(key) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        totals.groupBy("_block")
        .agg(F.sum(value).alias("_sum"))
        .select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = totals.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        within.join(blocks, "_block")
        .withColumn(out, (F.col("_base") + F.col("_inside")).cast("long"))
        .drop("_block", "_base", "_inside")
    )


def numbered(df: DataFrame, order: list[Column], out: str, name: str) -> tuple[DataFrame, int]:
    """``df`` with ``out``: each row's place, from 0, in ``order``; written to the shared folder under ``name``.
    Also the number of rows.

    Rows are dealt out by ranges of ``order`` and a salt, so rows that ``order``
    can't tell apart are spread as well (their places among each other are
    arbitrary); sorted within a range; and written, which fixes their places.
    Prefix sums over the ranges' counts place every range: no window sees the rows.
    """
    salt = fresh_name("_salt", df.columns)
    at = fresh_name("_at", [*df.columns, out])
    dealt = df.withColumn(salt, F.rand(17)).repartitionByRange(*order, F.col(salt))
    placed = dealt.sortWithinPartitions(*order, salt).drop(salt).withColumn(at, F.monotonically_increasing_id())
    rows = write_table(placed, name)
    part, base = fresh_name("_range", [*rows.columns, out]), fresh_name("_first", [*rows.columns, out])
    rows = rows.withColumn(part, F.shiftright(at, 33))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per range, 16 bytes each, whatever the rows hold.
    bases = F.broadcast(prefix_sums(counts, part, "_rows", base).select(part, base))
    number = F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    return rows.join(bases, part).withColumn(out, number).drop(part, base, at), total
