"""Spark column expressions used by the operators (no UDFs)."""

from segstats.functions.exprs import (
    BLANK_PATTERN,
    NUMERIC_TEXT_PATTERN,
    WHITESPACE_CLASS,
    in_values,
    is_blank,
    is_floating_type,
    is_numeric_type,
    label_text,
    nan_as_null,
    numeric_value,
    ordinal_in,
    percent,
    ratio,
    readability_class,
)

__all__ = [
    "BLANK_PATTERN",
    "NUMERIC_TEXT_PATTERN",
    "WHITESPACE_CLASS",
    "in_values",
    "is_blank",
    "is_floating_type",
    "is_numeric_type",
    "label_text",
    "nan_as_null",
    "numeric_value",
    "ordinal_in",
    "percent",
    "ratio",
    "readability_class",
]
