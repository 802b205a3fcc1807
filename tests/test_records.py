"""FIXTURES F6 (CSV text)."""

import itertools
import random

import pytest

from conftest import rows
from segstats import preview, read_records
from segstats.session import shared_dir
from segstats.sources.quoted import quoted_records, range_starts


def write(spark, text):
    """Write ``text`` as one file into a fresh folder of the shared location, through Spark."""
    path = shared_dir(spark, "csv-test")
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    return path


def test_na_tokens_and_types(spark):
    path = write(spark, 'id,amount,flag,note\n1,1.5,True,NA\n2,,False,"say ""hi"""\n3,n/a,True,null\n')
    df = read_records(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "boolean", "string"]
    out = rows(df.orderBy("id"))
    assert out[0] == {"id": 1, "amount": 1.5, "flag": True, "note": None}
    assert out[1]["amount"] is None and out[1]["note"] == 'say "hi"'
    assert out[2]["amount"] is None and out[2]["note"] is None


def test_quoted_newline(spark):
    path = write(spark, 'id,note\n1,"two\nlines"\n2,plain\n')
    out = rows(read_records(spark, path, multi_line=True).orderBy("id"))
    assert out[0]["note"] == "two\nlines"


def test_short_row_padded_long_row_refused(spark):
    short = write(spark, "a,b,c\n1,2,3\n4,5\n")
    out = rows(read_records(spark, short).orderBy("a"))
    assert out[1] == {"a": 4, "b": 5, "c": None}
    long = write(spark, "a,b,c\n1,2,3\n4,5,6,7\n")
    with pytest.raises(ValueError, match="more fields"):
        read_records(spark, long)


def test_all_empty_column_is_double(spark):
    path = write(spark, "a,b\n1,\n2,\n")
    assert read_records(spark, path).schema["b"].dataType.simpleString() == "double"


def test_schema_given(spark):
    path = write(spark, "a,b\n1,x\nNA,y\n")
    df = read_records(spark, path, schema="a int, b string")
    assert rows(df.orderBy("b")) == [{"a": 1, "b": "x"}, {"a": None, "b": "y"}]


def test_preview(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r["k"] for r in rows(preview(df, 5, ["k"]))] == [0, 1, 2, 3, 4]


def test_duplicate_header_names(spark):
    path = write(spark, "a,a,b,a\n1,2,3,4\n")
    df = read_records(spark, path)
    assert df.columns == ["a", "a.1", "b", "a.2"]
    assert rows(df) == [{"a": 1, "a.1": 2, "b": 3, "a.2": 4}]


@pytest.mark.parametrize("row", ["4,5,6,", '4,5,6,""', '"4","5","6","7"', "4,5,6,NA"])
def test_every_long_row_is_refused(spark, row):
    path = write(spark, f"a,b,c\n1,2,3\n{row}\n")
    with pytest.raises(ValueError, match="more fields"):
        read_records(spark, path)


def test_separators_and_quotes_inside_quotes_are_no_fields(spark):
    path = write(spark, 'a,b,c\n"1,1","x ""y, z""",3\n"2,2",","\n')
    out = rows(read_records(spark, path).orderBy("a"))
    assert out[0] == {"a": "1,1", "b": 'x "y, z"', "c": 3}
    assert out[1] == {"a": "2,2", "b": ",", "c": None}


def test_schema_is_matched_by_header_name(spark):
    path = write(spark, "b,a\nx,1\ny,2\n")
    df = read_records(spark, path, schema="a int, b string")
    assert rows(df.orderBy("a")) == [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    with pytest.raises(ValueError, match="no column c"):
        read_records(spark, path, schema="a int, c string")


def test_files_with_different_headers_are_refused(spark):
    path = shared_dir(spark, "csv-headers")
    for name, text in (("x", "a,b\n1,2"), ("y", "b,a\n3,4")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
    with pytest.raises(ValueError, match="headers"):
        read_records(spark, f"{path}/*")


def write_files(spark, *texts):
    path = shared_dir(spark, "csv-files")
    for k, text in enumerate(texts):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{k}")
    return f"{path}/*"


def test_every_header_is_compared_when_names_are_made_up(spark):
    with pytest.raises(ValueError, match="headers"):
        read_records(spark, write_files(spark, "a,a,b\n1,2,3", "b,a,a\n30,10,20"))
    with pytest.raises(ValueError, match="headers"):
        read_records(spark, write_files(spark, "a,,b\n1,2,3", "a,c,b\n1,2,3"))
    with pytest.raises(ValueError, match="headers"):
        read_records(spark, write_files(spark, 'a,a,b\n"x\ny",2,3', "b,a,a\n30,10,20"), multi_line=True)
    df = read_records(spark, write_files(spark, "a,a,b\n1,2,3", '"a",a,"b"\n4,5,6', "\na,a,b"))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 2, 3), (4, 5, 6)]


QUOTED = ["plain", 'say ""hi""', "two\nlines", "a\n\n\nb", ",\n,", '""', "\n", "", 'x""\n""', "carriage\r\nreturn", "é\n日本"]


def quoted_text(seed, rows):
    rng = random.Random(seed)
    lines = ["id,a,b"]
    for i in range(rows):
        a, b = (f'"{rng.choice(QUOTED)}"' if rng.random() < 0.7 else rng.choice(["bare", 'in"side', ""]) for _ in "ab")
        lines.append(f"{i},{a},{b}")
    return "\n".join(lines)


@pytest.mark.parametrize("range_bytes", [64, 700, 1 << 27])
def test_ranges_of_a_file_give_the_rows_of_a_whole_read(spark, range_bytes):
    path = write_files(spark, quoted_text(1, 300), quoted_text(2, 40), "id,a,b\n900," + '"' + "long\n" * 400 + '",x')
    whole = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
        .option("lineSep", "\n").schema("id string, a string, b string").csv(path)
    )
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        df = read_records(spark, path, schema="id string, a string, b string", na_values=(), multi_line=True)
        got = sorted((tuple(r) for r in df.collect()), key=str)
        tasks = quoted_records(spark, path).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == sorted((tuple(r) for r in whole.collect()), key=str)
    assert len(got) == 341 and (range_bytes > 1000 or tasks > 8)


def test_how_ranges_begin():
    """All sixteen pairs of one-bit functions compose in order, file by file."""
    for f, g in itertools.product(itertools.product([False, True], repeat=2), repeat=2):
        got = range_starts([("b", 0, True, True), ("a", 9, *g), ("a", 0, *f), ("a", 20, False, False)])
        assert got == {("a", 0): False, ("a", 9): f[0], ("a", 20): g[f[0]], ("b", 0): False}


def test_long_rows_and_empty_files_with_quoted_line_breaks(spark):
    with pytest.raises(ValueError, match="more fields"):
        read_records(spark, write_files(spark, 'a,b\n"1\n2",3\n"4\n",5,6'), multi_line=True)
    short = read_records(spark, write_files(spark, 'a,b\n"1\n2"\n'), multi_line=True)
    assert rows(short) == [{"a": "1\n2", "b": None}]
    assert read_records(spark, write_files(spark, ""), multi_line=True).count() == 0
    assert read_records(spark, write_files(spark, "a,b"), multi_line=True).count() == 0
