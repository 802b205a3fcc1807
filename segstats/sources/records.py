"""Reading delimited text into a typed DataFrame (S1) and previewing it.

The files are read by ranges, with line breaks inside quotes too.
Fields are first read as text so that the usual missing-value tokens can be
turned into NULL, then typed. Type inference, the ragged-row check and the
missing-token mapping cost ONE extra aggregate job over the file (a one-row
result), not a pass per column.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from segstats.functions.exprs import numeric_value
from segstats.sources.quoted import quoted_records

# --- Fixed values: text read as missing by default (pandas' default list) ----
DEFAULT_NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Text read as booleans when a whole column consists of them.
TRUE_VALUES = ("True", "TRUE", "true")
FALSE_VALUES = ("False", "FALSE", "false")
# -----------------------------------------------------------------------------

_CORRUPT = "_segstats_corrupt"
#: Header lines that are compared; files that agree have one, or a few that differ in their quotes.
MOST_HEADERS = 1000
_INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def _named(first: Sequence[str | None]) -> list[str]:
    """Column names of a header row: a repeated name gets a numbered suffix (a, a.1, a.2), an empty one is made up."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for i, v in enumerate(first):
        name = str(v) if v else f"Unnamed: {i}"
        base, k = name, seen.get(name, 0)
        while name in names:
            k += 1
            name = f"{base}.{k}"
        seen[base] = k
        names.append(name)
    return names


def _headers(records: DataFrame, path: str, sep: str) -> list[str]:
    """The fields of the first record of the files, which must be the same in all of them; none without a record."""
    found = records.where("first").select("record").distinct().limit(MOST_HEADERS).collect()
    fields = {tuple(next(csv.reader([r["record"]], delimiter=sep))) for r in found}
    if len(fields) > 1:
        raise ValueError(f"the files of {path} have different headers")
    return list(fields.pop()) if fields else []


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(first, record): the first line of each file that isn't blank. Only the ranges that begin a file send one."""
    lines = spark.read.text(path).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("file"),
                                         F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("start"))
    return (
        lines.where((F.col("start") == 0) & (F.trim("record") != ""))
        .groupBy("file").agg(F.min_by("record", "at").alias("record")).withColumn("first", F.lit(True))
    )


def read_records(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    na_values: Sequence[str] = DEFAULT_NA_VALUES,
    sep: str = ",",
    multi_line: bool = False,
    infer_types: bool = True,
) -> DataFrame:
    """Read a delimited file with a header row into a DataFrame.

    * every field equal to one of ``na_values`` becomes NULL (quoted or not);
    * doubled quotes inside quoted fields are unescaped; quoted line breaks
      need ``multi_line=True`` (the files are then read twice by ranges, each
      range by its own task: ``segstats.sources.quoted``);
    * a row with fewer fields than the header is padded with NULL; a row with
      more fields is refused with ``ValueError``;
    * without ``schema`` the header names the columns; a repeated name gets a
      numbered suffix (``a``, ``a.1``) and an empty one ``Unnamed: <i>``;
      several files must have the same header, else ``ValueError``;
    * with ``schema`` its columns are found by name in the header, whatever
      their order there, and cast (a value that does not fit fails the job); a
      name that is absent is refused with ``ValueError``; otherwise, with ``infer_types``, a column whose present
      values are all integers becomes ``bigint``, all numbers ``double``, all
      booleans ``boolean``, a column with no present value ``double``, and
      any other column stays ``string``.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    records = quoted_records(spark, path, sep) if multi_line else _first_lines(spark, path)
    names = _named(_headers(records, path, sep))
    if not names:
        return spark.createDataFrame([], schema or StructType())
    if schema is not None and (absent := [n for n in schema.fieldNames() if n not in names]):
        raise ValueError(f"the header of {path} has no column {', '.join(absent)}: {', '.join(names)}")
    text_schema = ", ".join(f"`{n}` string" for n in names) + f", `{_CORRUPT}` string"
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    if multi_line:
        parsed = records.where("NOT first").select(F.from_csv("record", text_schema, options).alias("_r"))
        raw = parsed.select("_r.*")
    else:
        # the headers are compared above, so the reader needn't
        raw = spark.read.schema(text_schema).options(header=True, enforceSchema=True, **options).csv(path)
    # The fields of a malformed row: its separators outside fields that start with a quote.
    mark = re.escape(sep)
    bare = F.regexp_replace(F.col(_CORRUPT), f'(^|{mark})"[^"]*+(?:""[^"]*+)*+"', "$1")
    fields = F.size(F.split(bare, mark, -1))
    long_row = F.col(_CORRUPT).isNotNull() & (fields > len(names))
    tokens = list(na_values)
    cleaned = {n: F.when(F.col(f"`{n}`").isin(tokens), F.lit(None)).otherwise(F.col(f"`{n}`")) for n in names}

    checks = [F.count_if(long_row).alias("_long")]
    if schema is None and infer_types:
        for i, n in enumerate(names):
            v = cleaned[n]
            checks += [
                F.count(v).alias(f"_n{i}"),
                F.count_if(v.isNotNull() & ~(v.rlike(_INTEGER_TEXT) & v.try_cast("bigint").isNotNull())).alias(f"_i{i}"),
                F.count_if(v.isNotNull() & numeric_value(v).isNull()).alias(f"_d{i}"),
                F.count_if(v.isNotNull() & ~v.isin(list(TRUE_VALUES + FALSE_VALUES))).alias(f"_b{i}"),
            ]
    # Count a data column next to the corrupt-record column (Spark refuses a
    # raw CSV query that reads only the latter).
    stats = raw.agg(F.count(F.col(f"`{names[0]}`")).alias("_first"), *checks).first()
    if stats["_long"]:
        raise ValueError(f"{stats['_long']} row(s) of {path} hold more fields than the {len(names)} header columns")

    out: list[Column] = []
    for i, n in enumerate(names if schema is None else schema.fieldNames()):
        v = cleaned[n]
        if schema is not None:
            out.append(v.cast(schema[n].dataType).alias(n))
        elif not infer_types:
            out.append(v.alias(n))
        elif stats[f"_n{i}"] == 0:
            out.append(v.cast("double").alias(n))
        elif stats[f"_i{i}"] == 0:
            out.append(F.trim(v).cast("bigint").alias(n))
        elif stats[f"_d{i}"] == 0:
            out.append(numeric_value(v).alias(n))
        elif stats[f"_b{i}"] == 0:
            out.append(v.isin(list(TRUE_VALUES)).alias(n))
        else:
            out.append(v.alias(n))
    return raw.select(*out)


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows (S2); ordered by ``order_by`` when given (a top-k, not a sort)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
