"""Column-level building blocks shared by every operator.

Each helper returns a ``pyspark.sql.Column`` built from Spark's own
expressions, so it runs inside whole-stage code generation on the executors.
None of them is a UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DoubleType,
    FloatType,
    NumericType,
    StringType,
)

# --- Fixed values -------------------------------------------------------------
# Characters Python's ``str.isspace`` treats as whitespace, in code-point order.
# A value made only of these is "blank": present, but empty after ``strip()``.
# Spark's ``trim`` removes U+0020 only, and Java's ``\s`` misses U+001C-U+001F,
# so the class is spelled out. ``\x{...}`` is understood by Java and RE2 alike.
WHITESPACE_CLASS = (
    r"[\x{09}\x{0A}\x{0B}\x{0C}\x{0D}\x{1C}\x{1D}\x{1E}\x{1F}\x{20}\x{85}\x{A0}"
    r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
BLANK_PATTERN = "^" + WHITESPACE_CLASS + "*$"

# Text that a lenient numeric parse (missing on failure) turns into a number:
# optional ASCII spaces around a signed decimal with optional exponent, or a
# bare signed "inf"/"infinity". Hex, thousands separators, type suffixes such
# as ``1d``, ``nan`` and padding other than ASCII whitespace are not numbers.
NUMERIC_TEXT_PATTERN = r"(?i)^(\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*|[+-]?inf(inity)?)$"
# -----------------------------------------------------------------------------


def is_numeric_type(dt: DataType) -> bool:
    """Numeric in the sense of the analyses: Spark numeric, never boolean."""
    return isinstance(dt, NumericType) and not isinstance(dt, BooleanType)


def is_floating_type(dt: DataType) -> bool:
    return isinstance(dt, (FloatType, DoubleType))


def field_type(df: DataFrame, name: str) -> DataType:
    return df.schema[name].dataType


def nan_as_null(df: DataFrame, name: str) -> Column:
    """The column with floating NaN read as missing (the tables' convention)."""
    c = df[name]
    if is_floating_type(field_type(df, name)):
        return F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return c


def row_key(df: DataFrame, name: str) -> Column:
    """The column as a grouping or hashing key: NaN is missing, and the two zeros are one value."""
    if is_floating_type(field_type(df, name)):
        return nan_as_null(df, name) + F.lit(0.0).cast(field_type(df, name))
    return df[name]


def label_text(df: DataFrame, name: str) -> Column:
    """A label compared as text, case-sensitively.

    An integer label ``1`` becomes the text ``'1'`` and is therefore an
    unexpected value rather than a failed cast at run time.
    """
    c = nan_as_null(df, name)
    if isinstance(field_type(df, name), StringType):
        return c
    return c.cast("string")


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; NULL (undefined) when the denominator is 0 or NULL."""
    return F.try_divide(numerator, denominator)


def percent(count: Column, total: Column) -> Column:
    """``count / total * 100`` in that order; NULL when ``total`` is 0."""
    return F.try_divide(count, total) * F.lit(100.0)


def in_values(c: Column, values: Iterable) -> Column:
    """Membership that is never NULL: a missing value is not a member."""
    return F.coalesce(c.isin(list(values)), F.lit(False))


def ordinal_in(c: Column, values: Sequence) -> Column:
    """1-based position of ``c`` in ``values``; 0 when absent or NULL."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), c), F.lit(0))


def is_blank(c: Column) -> Column:
    """Present and empty or whitespace-only (Unicode whitespace)."""
    return c.isNotNull() & c.cast("string").rlike(BLANK_PATTERN)


def numeric_value(c: Column) -> Column:
    """Lenient numeric reading of text: a double, or NULL when not a number.

    ``try_cast`` alone accepts ``1d``, ``0x1p3``, ``nan`` and turns overflow into
    infinity; the whitelist and the infinity guard keep only plain decimals and
    explicit infinities.
    """
    text = c.cast("string")
    parsed = F.when(text.rlike(NUMERIC_TEXT_PATTERN), text.try_cast("double"))
    overflow = F.abs(parsed) == F.lit(float("inf"))
    return F.when(overflow & ~F.lower(text).contains("inf"), F.lit(None)).otherwise(parsed)


def readability_class(c: Column) -> Column:
    """missing / blank / convertible / non_numeric; the four partition the rows."""
    return (
        F.when(c.isNull(), F.lit("missing"))
        .when(is_blank(c), F.lit("blank"))
        .when(numeric_value(c).isNotNull(), F.lit("convertible"))
        .otherwise(F.lit("non_numeric"))
    )
