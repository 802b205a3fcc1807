"""Packing: concatenate and cut.

Every document's ids, closed by an end id, are laid end to end and cut into
windows of ``window`` tokens, so only the last window can be short. Two
passes: tasks encode their documents and write them with the running token
total of their partition; prefix sums over the partition totals then give each
document's place in the whole, and a document that crosses window ends becomes
one boundary record per window. No document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import prefix_sums, prepare_workers, text_of, write_table

#: Ids are held as little-endian unsigned 32-bit integers.
ID_BYTES = 4


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(part, before, doc_id, n_tokens, ids): written to the shared folder, ids with the end id.

    ``part`` is the task's partition and ``before`` the tokens of the rows
    before this one in it; writing fixes both, whatever is run again later.
    """
    prepare_workers(docs.sparkSession)
    end = int(end_id).to_bytes(ID_BYTES, "little")
    id_type = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from segstats.llm.tokenization import encoder

        ids_of = encoder(tokenizer).ids
        part = TaskContext.get().partitionId()
        total = 0
        for batch in batches:
            ids = [ids_of(t) + end for t in batch.column(1).to_pylist()]
            before, n = [], []
            for x in ids:
                before.append(total)
                n.append(len(x) // ID_BYTES)
                total += n[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(before, pa.int64()),
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["part", "before", "doc_id", "n_tokens", "ids"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = f"part int, before long, doc_id {id_type.simpleString()}, n_tokens long, ids binary"
    return write_table(source.mapInArrow(encode, schema), "packed-ids")


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's ids (little-endian uint32), ``start`` the
    document's ids before it, ``offset`` its place in the sequence. A null or
    empty text is its end id alone; rows with equal or null doc_id are separate
    documents; an empty table gives no rows; other columns are not read. A text
    of any length is cut into as many pieces as it needs.
    """
    encoded = encode_documents(docs, tokenizer, end_id, id_col, text_col)
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row per input partition: 12 bytes each, whatever the documents hold.
    offsets = F.broadcast(prefix_sums(totals, "part", "total", "base").select("part", "base"))
    placed = encoded.join(offsets, "part").withColumn("_from", F.col("base") + F.col("before"))
    cut = placed.withColumn(
        "sequence_id",
        F.explode(
            F.sequence(
                F.floor(F.col("_from") / window), F.floor((F.col("_from") + F.col("n_tokens") - 1) / window)
            )
        ),
    )
    first = F.greatest(F.col("_from"), F.col("sequence_id") * window)
    last = F.least(F.col("_from") + F.col("n_tokens"), (F.col("sequence_id") + 1) * window)
    cut = cut.withColumn("start", first - F.col("_from")).withColumn("length", last - first)
    return cut.select(
        "doc_id",
        "start",
        "length",
        F.substring(
            F.col("ids"), (F.col("start") * ID_BYTES + 1).cast("int"), (F.col("length") * ID_BYTES).cast("int")
        ).alias("ids"),
        F.col("n_tokens").alias("doc_tokens"),
        "sequence_id",
        (first - F.col("sequence_id") * window).alias("offset"),
    )


def sequences(pieces: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (uint32 little-endian, padded).

    A sequence shorter than ``window`` is padded to it, unless its length is
    already a power of two. A group holds at most ``window`` pieces, since
    every piece has a token.
    """
    pad = int(pad_id).to_bytes(ID_BYTES, "little").hex()
    joined = (
        pieces.groupBy("sequence_id")
        .agg(
            F.sum("length").alias("n_tokens"),
            F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))).alias("p"),
        )
        .withColumn("h", F.array_join(F.transform("p", lambda x: x["h"]), ""))
    )
    short = (F.col("n_tokens") < window) & (F.bit_count("n_tokens") != 1)
    missing = F.when(short, F.lit(window) - F.col("n_tokens")).otherwise(F.lit(0)).cast("int")
    return joined.select(
        "sequence_id", "n_tokens", F.unhex(F.concat("h", F.repeat(F.lit(pad), missing))).alias("ids")
    )
