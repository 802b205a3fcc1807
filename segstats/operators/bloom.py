"""A Bloom filter in DataFrame functions: which rows of a scan may have a key, before any of them is shuffled.

The filter is cut into blocks of ``WORDS`` longs. A key's block and its
``PROBES`` bits in it come from the key's hash, so testing a row is one lookup of a
broadcast hash join and a few bit operations in the scan's own stage. No row
with a key is lost; about one row in a hundred without one passes, more once
the filter has its full size. An exact join has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longs in a block, bits set for a key, keys meant for a block, and the most blocks (16 MB in all).
WORDS, PROBES, KEYS, MOST_BLOCKS = 64, 4, 400, 1 << 15
#: Bits of the hash that choose a bit of a block.
_BITS = (64 * WORDS - 1).bit_length()


def _places(key: Column) -> list[Column]:
    """The bits of a key in its block."""
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftright(h, k * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int") for k in range(PROBES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)))


def block_count(keys: int) -> int:
    """Blocks for so many keys; the count is bounded, so the filter is too, whatever the keys."""
    return max(1, min(MOST_BLOCKS, -(-keys // KEYS)))


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_bloom_block, _bloom_words): one row for each block that has a key."""
    places = F.explode(F.array(*_places(F.col(key)))).alias("_place")
    bits = keys.select(_block(F.col(key), blocks).alias("_bloom_block"), places)
    words = bits.groupBy("_bloom_block", F.shiftright("_place", 6).alias("_word")).agg(
        F.bit_or(_mask(F.col("_place"))).alias("_bits")
    )
    every = F.sequence(F.lit(0), F.lit(WORDS - 1))
    held = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))
    return (
        words.groupBy("_bloom_block")
        .agg(held.alias("_held"))
        .select("_bloom_block", F.transform(every, lambda w: F.coalesce(F.col("_held")[w], F.lit(0).cast("long"))).alias("_bloom_words"))
    )


def may_have(df: DataFrame, key: str, keys: DataFrame, count: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among the ``count`` rows of ``keys`` (same column name)."""
    blocks = block_count(count)
    bloom = F.broadcast(bloom_filter(keys, key, blocks))  # MOST_BLOCKS rows of half a kilobyte at most
    words = F.col("_bloom_words")
    found = df.withColumn("_bloom_block", _block(F.col(key), blocks)).join(bloom, "_bloom_block")
    test = F.lit(True)
    for place in _places(F.col(key)):
        test = test & (F.get(words, F.shiftright(place, 6)).bitwiseAND(_mask(place)) != 0)
    return found.where(test).drop("_bloom_block", "_bloom_words")
