"""Delimited records with line breaks inside quotes, read by byte ranges.

Whether a line break ends a record depends on every quote before it, so
Spark's own reader takes such a file whole. Here a file is read in its ranges,
twice. Pass one tells of each range whether it ends inside a quoted field, both for
a range that begins inside one and for one that doesn't (two bits a range).
Composing these over the ranges of a file, a prefix product of functions of
one bit, gives how each range begins. Pass two joins lines to records; the
pieces of a record that crosses a range, at most two for each range, are put
together afterwards. The lines are walked in order, which no built-in expression
does, so both passes are Arrow map functions; fields are parsed by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _walker(sep: str):
    """``after(line, inside)``: whether the line break after a line is inside a quoted field.

    A quote opens a field only as its first character; inside, two quotes are
    one; whatever follows the closing quote belongs to the field up to the separator.
    """
    close = re.compile(r'[^"]*+(?:""[^"]*+)*+"')

    def after(line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        at = 0
        while True:
            if inside or line.startswith('"', at):
                ended = close.match(line, at if inside else at + 1)
                if not ended:
                    return True
                inside, at = False, ended.end()
            at = line.find(sep, at)
            if at < 0:
                return False
            at += len(sep)

    return after


def range_starts(found: list[tuple[str, int, bool, bool]]) -> dict[tuple[str, int], bool]:
    """How each range (file, start) begins, from how it ends if it begins outside and inside a quoted field."""
    begins, last, inside = {}, None, False
    for file, start, outside_in, inside_in in sorted(found):
        if file != last:
            last, inside = file, False
        begins[file, start] = inside
        inside = inside_in if inside else outside_in
    return begins


def quoted_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, first, record): every record of the files at ``path``, line breaks inside quotes kept.

    ``first`` marks the first record of a file. Records without a character are
    left out; a quote that is never closed takes in the rest of its file. A
    task holds one record at a time; the driver gets two bits for each range,
    as many as the scan has.
    """
    # a line ends at \n only, so a \r before it stays: inside quotes it belongs to the field
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, found = _walker(sep), {}
        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                outside, inside = found.get((file, start), (False, True))
                found[file, start] = (after(line, outside), after(line, inside))
        rows = [(f, s, a, b) for (f, s), (a, b) in found.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "outside", "inside"]
        )

    found = lines.mapInArrow(ends, "file string, start long, outside boolean, inside boolean").collect()
    begins = spark.sparkContext.broadcast(range_starts([tuple(r) for r in found]))
    names = ["file", "start", "place", "opens", "closes", "record"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, at, inside, opened, place, some = _walker(sep), None, False, False, 0, []

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names)

        for batch in batches:
            out = []
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (file, start):
                    if some:
                        out.append((*at, place, opened, False, "\n".join(some)))
                    at, place, some = (file, start), 0, []
                    inside = begins.value[at]
                    opened = not inside
                some.append(line)
                inside = after(line, inside)
                if not inside:
                    out.append((file, start, place, opened, True, "\n".join(some)))
                    place, opened, some = place + 1, True, []
            yield sent(out)
        if some:
            yield sent([(*at, place, opened, False, "\n".join(some))])

    cut = lines.mapInArrow(
        pieces, "file string, start long, place long, opens boolean, closes boolean, record string"
    )
    first = (F.col("start") == 0) & (F.col("place") == 0)
    whole = cut.where("opens AND closes").select("file", first.alias("first"), "record")
    order = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    broken = cut.where("NOT (opens AND closes)").withColumn("_record", F.sum(F.col("opens").cast("int")).over(order))
    joined = broken.groupBy("file", "_record").agg(
        F.max(first & F.col("opens")).alias("first"),
        F.array_sort(F.collect_list(F.struct("start", "place", "record"))).alias("_pieces"),
    )
    joined = joined.select(
        "file", "first", F.array_join(F.transform("_pieces", lambda p: p["record"]), "\n").alias("record")
    )
    text = F.regexp_replace("record", "\r$", "")
    return whole.unionByName(joined).withColumn("record", text).where("record <> ''")
