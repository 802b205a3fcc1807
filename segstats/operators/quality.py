"""Non-destructive data-quality evidence.

Nothing here alters, cleans or drops data: every operator returns counts or
the affected rows. Plan shape:

* single-row counters (shape, missing, readability classes, numeric checks)
  are one global aggregate each, fused where they share an input, then turned
  into rows with ``inline`` on the one-row result;
* per-value counts over many columns (profiles, domain departures,
  implication violations) unpivot the columns first and aggregate once, so a
  wide table costs one scan and one shuffle, with partial aggregation before
  the shuffle;
* samples are top-k (``orderBy().limit()``), never a collect of affected rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.functions.exprs import (
    in_values,
    is_numeric_type,
    nan_as_null,
    numeric_value,
    ordinal_in,
    percent,
    readability_class,
    row_key,
)
from segstats.operators.bloom import may_have
from segstats.operators.materialize import materialize
from segstats.operators.quantiles import bracket_columns, exact_quantiles
from segstats.operators.roles import require_columns

READABILITY_CLASSES = ("missing", "blank", "non_numeric", "convertible")
QUARTILES = (0.25, 0.5, 0.75)
SAMPLE_SIZE = 10


def _rows(structs: list[Column]) -> Column:
    return F.inline(F.array(*structs))


def _missing(df: DataFrame, c: str) -> Column:
    return nan_as_null(df, c).isNull()


# S3 --------------------------------------------------------------------------


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns of the table, one row (S3)."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count")
    )


# S4 --------------------------------------------------------------------------


def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: position, Spark type and non-missing count, in column order."""
    counts = df.agg(*[F.count(nan_as_null(df, c)).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    return counts.select(
        _rows(
            [
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(i).alias("position"),
                    F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                    F.col(f"_c{i}").alias("non_null_count"),
                )
                for i, c in enumerate(df.columns)
            ]
        )
    )


# Q3 --------------------------------------------------------------------------


def missing_by_column(df: DataFrame) -> DataFrame:
    """Per column: missing count and percent of rows; blanks are present (Q3).

    Columns: ``column_name, position, missing_count, missing_percent``.
    Floating NaN counts as missing. One scan, no shuffle.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)],
    )
    return counts.select(
        _rows(
            [
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(i).alias("position"),
                    F.col(f"_m{i}").alias("missing_count"),
                    percent(F.col(f"_m{i}"), F.col("_rows")).alias("missing_percent"),
                )
                for i, c in enumerate(df.columns)
            ]
        )
    )


# Q1 / Q2 ---------------------------------------------------------------------


def _repeats(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Rows equal in ``cols`` to an earlier one, as the sum of (group size - 1).

    Exact, and wide rows without a repeat are not shuffled: a 64-bit
    fingerprint of each row is counted first (8 bytes a row, combined in the
    tasks) and the repeated ones are written to the checkpoint folder. A second scan
    drops the rows whose fingerprint isn't in their Bloom filter, an exact join
    the few that pass it by chance, and the rest are grouped by their full
    values, which removes any fingerprint collision.
    """
    keyed = df.select(*[row_key(df, c).alias(f"_k{i}") for i, c in enumerate(cols)])
    keyed = keyed.withColumn("_fp", F.xxhash64(*keyed.columns))
    repeated = materialize(keyed.groupBy("_fp").count().where(F.col("count") > 1).select("_fp"))
    return (
        may_have(keyed, "_fp", repeated, repeated.count())
        .join(repeated, "_fp")  # each is there once; a semi join would be moved below the filter
        .groupBy(*[f"_k{i}" for i in range(len(cols))])
        .count()
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias(name))
    )


def count_duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row; missing, NaN included, equals missing (Q1)."""
    cols = list(columns) if columns is not None else list(df.columns)
    require_columns(df, cols)
    return _repeats(df, cols, "duplicate_rows")


def count_duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Repeats of an id value; a second missing id, NaN included, also counts (Q2).

    Ids of a fixed few bytes are counted as they are; texts and other wide ids
    go by fingerprint first, so they are not shuffled.
    """
    require_columns(df, [id_column])
    kind = df.schema[id_column].dataType
    if not (is_numeric_type(kind) or kind.typeName() in ("boolean", "date", "timestamp", "timestamp_ntz")):
        return _repeats(df, [id_column], "duplicate_ids")
    return (
        df.groupBy(row_key(df, id_column).alias("_id"))
        .count()
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_ids"))
    )


# Q4 / Q5 ---------------------------------------------------------------------


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns neither numeric (booleans count as numeric here) nor excluded (Q4)."""
    return [
        f.name
        for f in df.schema.fields
        if not (is_numeric_type(f.dataType) or f.dataType.typeName() == "boolean") and f.name not in exclude
    ]


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """How often each value of each text column occurs, as a count and as a percent of the rows (Q5).

    A missing value counts as a value. Order: column order, most frequent
    first, then value. Columns: ``column_name, value, value_count,
    value_percent``. All columns are unpivoted and counted in one aggregation,
    whose exchange also gives the number of rows: one scan.
    """
    cols = list(columns) if columns is not None else categorical_columns(df, exclude)
    require_columns(df, cols)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, value string, value_count bigint, value_percent double"
        )
    long = df.select(*[nan_as_null(df, c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "value"
    )
    counted = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("value_count"))
    # Every column has each row once, so the counts add up to the rows times the columns.
    total = counted.groupBy().agg((F.sum("value_count") / len(cols)).alias("n")).scalar()
    return (
        counted.select(
            "column_name",
            "value",
            "value_count",
            percent(F.col("value_count"), total).alias("value_percent"),
            ordinal_in(F.col("column_name"), cols).alias("_pos"),
        )
        .orderBy("_pos", F.desc("value_count"), F.asc_nulls_last("value"))
        .drop("_pos")
    )


# Q6 - Q8 ---------------------------------------------------------------------


@dataclass(frozen=True)
class Implication:
    """``trigger == trigger_value`` implies every dependent equals ``expected``.

    One-directional: the converse is not checked.
    """

    name: str
    trigger: str
    trigger_value: object
    dependents: tuple[str, ...]
    expected: object


def _violation(df: DataFrame, rule: Implication, dep: str) -> Column:
    return ~df[dep].eqNullSafe(F.lit(rule.expected))


def implication_violations(df: DataFrame, rules: Sequence[Implication]) -> DataFrame:
    """For rows meeting a rule's trigger, dependent values other than expected (Q6, Q7).

    A missing dependent is a violation. Dependents without departures have no
    rows. Columns: ``rule, column_name, expected_value, observed_value,
    affected_rows``. All rules are evaluated in one scan: each row emits only
    its departures, which are then counted in one aggregation.
    """
    for r in rules:
        require_columns(df, [r.trigger, *r.dependents])
    cells = []
    for r in rules:
        fired = F.coalesce(df[r.trigger] == F.lit(r.trigger_value), F.lit(False))
        for d in r.dependents:
            cells.append(
                F.when(
                    fired & _violation(df, r, d),
                    F.struct(
                        F.lit(r.name).alias("rule"),
                        F.lit(d).alias("column_name"),
                        F.lit(str(r.expected)).alias("expected_value"),
                        df[d].cast("string").alias("observed_value"),
                    ),
                )
            )
    if not cells:
        return df.sparkSession.createDataFrame(
            [], "rule string, column_name string, expected_value string, observed_value string, affected_rows bigint"
        )
    order = [f"{r.name}\u0000{d}" for r in rules for d in r.dependents]
    # Only rows meeting some trigger can depart; this plain filter reaches the scan.
    any_trigger = F.lit(False)
    for r in rules:
        any_trigger = any_trigger | (df[r.trigger] == F.lit(r.trigger_value))
    departures = (
        df.where(any_trigger)
        .select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("v"))
        .select("v.*")
    )
    return (
        departures.groupBy("rule", "column_name", "expected_value", "observed_value")
        .agg(F.count(F.lit(1)).alias("affected_rows"))
        .withColumn("_pos", ordinal_in(F.concat_ws("\u0000", "rule", "column_name"), order))
        .orderBy("_pos", F.desc("affected_rows"), F.asc_nulls_last("observed_value"))
        .drop("_pos")
    )


def implication_support(df: DataFrame, rules: Sequence[Implication]) -> DataFrame:
    """Per rule: rows meeting the trigger, rows departing, and whether it holds (Q8).

    Columns: ``rule, trigger_column, trigger_value, trigger_rows,
    violating_rows, holds``. One global aggregate for all rules.
    """
    for r in rules:
        require_columns(df, [r.trigger, *r.dependents])
    aggs = []
    for i, r in enumerate(rules):
        fired = F.coalesce(df[r.trigger] == F.lit(r.trigger_value), F.lit(False))
        any_bad = F.lit(False)
        for d in r.dependents:
            any_bad = any_bad | _violation(df, r, d)
        aggs += [F.count_if(fired).alias(f"_t{i}"), F.count_if(fired & any_bad).alias(f"_v{i}")]
    counts = df.agg(*aggs)
    return counts.select(
        _rows(
            [
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.lit(r.trigger).alias("trigger_column"),
                    F.lit(str(r.trigger_value)).alias("trigger_value"),
                    F.col(f"_t{i}").alias("trigger_rows"),
                    F.col(f"_v{i}").alias("violating_rows"),
                    (F.col(f"_v{i}") == 0).alias("holds"),
                )
                for i, r in enumerate(rules)
            ]
        )
    )


# Q9 - Q12 --------------------------------------------------------------------


def numeric_readability(df: DataFrame, column: str) -> DataFrame:
    """Rows per class of a text column's numeric reading (Q10).

    Classes, in order: missing, blank (present, whitespace only), non_numeric,
    convertible; they partition the rows. Columns: ``column_name,
    stored_type, value_class, row_count``. One scan, no shuffle.
    """
    require_columns(df, [column])
    cls = readability_class(nan_as_null(df, column))
    counts = df.agg(*[F.count_if(cls == F.lit(k)).alias(f"_{k}") for k in READABILITY_CLASSES])
    stored = df.schema[column].dataType.simpleString()
    return counts.select(
        _rows(
            [
                F.struct(
                    F.lit(column).alias("column_name"),
                    F.lit(stored).alias("stored_type"),
                    F.lit(k).alias("value_class"),
                    F.col(f"_{k}").alias("row_count"),
                )
                for k in READABILITY_CLASSES
            ]
        )
    )


def class_context(df: DataFrame, column: str, by: str, value_class: str = "blank") -> DataFrame:
    """Distribution of ``by`` over the rows of one readability class (Q11).

    Missing ``by`` values, NaN included, are left out. Most frequent first. Columns:
    ``<by>, row_count``.
    """
    require_columns(df, [column, by])
    if value_class not in READABILITY_CLASSES:
        raise ValueError(f"value_class must be one of {READABILITY_CLASSES}; got {value_class!r}")
    key = nan_as_null(df, by)
    return (
        df.where((readability_class(nan_as_null(df, column)) == value_class) & key.isNotNull())
        .groupBy(key.alias(by))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), F.asc(by))
    )


def affected_sample(
    df: DataFrame,
    predicate: Column,
    context: Sequence[str],
    order_by: Sequence[str],
    n: int = SAMPLE_SIZE,
) -> DataFrame:
    """Up to ``n`` affected rows (context columns) plus the total affected count (Q12).

    Top-k by ``order_by`` (``TakeOrderedAndProject``): each task keeps its own
    ``n`` best rows, so no full sort and no collect of affected rows. The count
    is a scan of its own that reads the predicate's columns alone. When no row
    is affected, one row of missing context columns tells the count of 0.
    """
    require_columns(df, [*context, *order_by])
    affected = df.where(predicate)
    total = affected.agg(F.count(F.lit(1)).alias("affected_count"))
    sample = affected.orderBy(*order_by).limit(n).select(*[df[c] for c in context])
    # One row to the left, at most n to the right.
    return total.join(F.broadcast(sample), F.lit(True), "left").select(*[f"`{c}`" for c in context], "affected_count")


def readability_sample(
    df: DataFrame, column: str, context: Sequence[str], order_by: Sequence[str], n: int = SAMPLE_SIZE
) -> DataFrame:
    """Q12 for the readability check: rows whose value is not convertible."""
    require_columns(df, [column])
    return affected_sample(df, readability_class(nan_as_null(df, column)) != "convertible", context, order_by, n)


# Q13 - Q15 -------------------------------------------------------------------


def below_minimum(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Observed minimum and the count below a documented minimum; missing never violates (Q13).

    Columns: ``column_name, minimum, observed_min, below_count``.
    """
    require_columns(df, [column])
    c = nan_as_null(df, column)
    return df.agg(
        F.min(c).cast("double").alias("observed_min"), F.count_if(c < F.lit(minimum)).alias("below_count")
    ).select(
        F.lit(column).alias("column_name"),
        F.lit(float(minimum)).alias("minimum"),
        "observed_min",
        "below_count",
    )


def below_minimum_values(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Each violating value with its row count, most frequent first (Q13)."""
    require_columns(df, [column])
    # NaN orders above every number in Spark, so ``<`` already leaves it out;
    # the plain comparison is pushed down to the scan.
    c = df[column]
    return (
        df.where(c < F.lit(minimum))
        .groupBy(c.alias(column))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), F.asc(column))
    )


def _members(df: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """The values of a domain table (its first column) once each, in the type of ``column``; missing ones are none."""
    values = domain.select(F.col(f"`{domain.columns[0]}`").cast(df.schema[column].dataType).alias("_value"))
    return values.select(nan_as_null(values, "_value").alias("_value")).where(F.col("_value").isNotNull()).distinct()


def outside_domain(df: DataFrame, column: str, allowed: Sequence | DataFrame) -> DataFrame:
    """Every observed value (missing included) with its count and whether it is allowed (Q14).

    A missing value is outside the domain. ``allowed`` is a list of values, or a
    table whose first column holds them, however many: the observed values are
    counted first and then joined with it, without a hint, so Spark broadcasts
    whichever it measures to be small. Columns: ``<column>, row_count,
    in_domain``; most frequent first.
    """
    require_columns(df, [column])
    counts = df.groupBy(nan_as_null(df, column).alias(column)).agg(F.count(F.lit(1)).alias("row_count"))
    if isinstance(allowed, DataFrame):
        members = _members(df, column, allowed).withColumn("_member", F.lit(True))
        joined = counts.join(members, F.col(column) == F.col("_value"), "left")
        told = joined.select(column, "row_count", F.coalesce("_member", F.lit(False)).alias("in_domain"))
    else:
        told = counts.withColumn("in_domain", in_values(F.col(column), allowed))
    return told.orderBy(F.desc("row_count"), F.asc_nulls_last(column))


def outside_domain_count(df: DataFrame, column: str, allowed: Sequence | DataFrame) -> DataFrame:
    """Rows outside the domain, a list or a table (missing included), one row (Q14)."""
    require_columns(df, [column])
    if isinstance(allowed, DataFrame):
        n = F.col("row_count")
        counts = outside_domain(df, column, allowed).agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.when(~F.col("in_domain"), n)), F.lit(0)).alias("outside_count"),
        )
    else:
        outside = ~in_values(nan_as_null(df, column), allowed)
        counts = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(outside).alias("outside_count"))
    return counts.select(F.lit(column).alias("column_name"), "row_count", "outside_count")


def range_profile(df: DataFrame, column: str) -> DataFrame:
    """Stored type, missing count and observed range; flags nothing (Q15)."""
    require_columns(df, [column])
    c = nan_as_null(df, column)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(c.isNull()).alias("missing_count"),
        F.min(c).cast("double").alias("observed_min"),
        F.max(c).cast("double").alias("observed_max"),
    ).select(
        F.lit(column).alias("column_name"),
        F.lit(df.schema[column].dataType.simpleString()).alias("stored_type"),
        "row_count",
        "missing_count",
        "observed_min",
        "observed_max",
    )


# Q16 -------------------------------------------------------------------------


def domain_conformance(df: DataFrame, domains: Mapping[str, Sequence | DataFrame]) -> DataFrame:
    """Per column, observed values outside its documented domain, a list or a table (Q16).

    Missing values are reported with status ``missing``, other departures
    ``unexpected``; conforming values produce no row. Columns: ``column_name,
    value, value_status, row_count``. One scan for all lists: each row emits
    only its departures, which one aggregation counts. One more for all tables:
    the values of their columns are counted and those in the tables taken out.
    """
    require_columns(df, list(domains))
    lists = {c: list(vals) for c, vals in domains.items() if not isinstance(vals, DataFrame)}
    tables = {c: vals for c, vals in domains.items() if isinstance(vals, DataFrame)}
    counted = df.sparkSession.createDataFrame([], "column_name string, value string, row_count bigint")

    def cell(c: str, *more: Column) -> Column:
        return F.struct(F.lit(c).alias("column_name"), nan_as_null(df, c).cast("string").alias("value"), *more)

    def counts(cells: Column) -> DataFrame:
        each = df.select(F.explode(cells).alias("v")).select("v.column_name", "v.value")
        return each.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("row_count"))

    if lists:
        cells = [cell(c, in_values(nan_as_null(df, c), vals).alias("_ok")) for c, vals in lists.items()]
        counted = counted.unionByName(counts(F.filter(F.array(*cells), lambda x: ~x["_ok"])))
    if tables:
        members = None
        for c, domain in tables.items():
            own = _members(df, c, domain).select(F.lit(c).alias("column_name"), F.col("_value").cast("string").alias("value"))
            members = own if members is None else members.unionByName(own)
        held = counts(F.array(*[cell(c) for c in tables]))
        counted = counted.unionByName(held.join(members, ["column_name", "value"], "left_anti"))
    return (
        counted.select(
            "column_name",
            "value",
            F.when(F.col("value").isNull(), "missing").otherwise("unexpected").alias("value_status"),
            "row_count",
            (ordinal_in(F.col("column_name"), list(domains)) if domains else F.lit(0)).alias("_pos"),
        )
        .orderBy("_pos", F.desc("row_count"), F.asc_nulls_last("value"))
        .drop("_pos")
    )


# Q17 -------------------------------------------------------------------------


def product_residual(df: DataFrame, total: str, a: str, b: str, tolerance: float = 0.005) -> DataFrame:
    """Evidence for ``total = a * b`` over rows whose total reads as a number (Q17).

    ``difference = total - a * b``; a difference within ``tolerance`` (half a
    cent by default) counts as zero. Columns: ``convertible_count,
    zero_difference_count, nonzero_difference_count, mean_abs_difference,
    min_difference, max_difference``. One scan, no shuffle.
    """
    require_columns(df, [total, a, b])
    t = nan_as_null(df, total) if is_numeric_type(df.schema[total].dataType) else numeric_value(df[total])
    # Factors multiply as doubles: NaN is missing and whole numbers do not overflow.
    product = nan_as_null(df, a).cast("double") * nan_as_null(df, b).cast("double")
    diff = (t.cast("double") - product).alias("_d")
    d = F.col("_d")
    return (
        df.select(diff)
        .where(d.isNotNull())
        .agg(
            F.count(F.lit(1)).alias("convertible_count"),
            F.count_if(F.abs(d) < F.lit(tolerance)).alias("zero_difference_count"),
            F.count_if(F.abs(d) >= F.lit(tolerance)).alias("nonzero_difference_count"),
            F.avg(F.abs(d)).alias("mean_abs_difference"),
            F.min(d).alias("min_difference"),
            F.max(d).alias("max_difference"),
        )
    )


# S5 --------------------------------------------------------------------------


#: Leading bytes of a text that order it among equally frequent ones; as a number they stay below 2^56.
_LEADING = 7


def _leading(value: Column) -> Column:
    """The first bytes of a text as a number of the same order (shorter texts are filled up with zero bytes)."""
    first = F.rpad(F.hex(F.substring(value.cast("binary"), 1, _LEADING)), 2 * _LEADING, "0")
    return F.conv(first, 16, 10).cast("long")


def _text_statistics(df: DataFrame, text: Sequence[str]) -> DataFrame:
    """(column_name, count, unique, top, freq) of the text columns that have a present value.

    Values are counted by a 128-bit fingerprint with their leading bytes, so no
    exchange holds the values. The most frequent fingerprints, of equally
    frequent ones those with the smallest leading bytes, are then looked for in
    a second scan (a Bloom filter first, then an exact join); each task sends
    its smallest such value of a column.
    """
    value = F.col("value")
    long = df.select(*[df[c].cast("string").alias(c) for c in text]).unpivot([], text, "column_name", "value")
    long = long.where(value.isNotNull()).withColumns(
        {"_fp": F.xxhash64("column_name", "value"), "_fp2": F.xxhash64(F.lit(2), "value", "column_name")}
    )
    # leading bytes follow from the value, so any of a fingerprint's rows tells them
    counted = long.groupBy("column_name", "_fp", "_fp2").agg(
        F.count(F.lit(1)).alias("_n"), F.min(_leading(value)).alias("_lead")
    )
    counted = materialize(counted)
    best = counted.groupBy("column_name").agg(
        F.sum("_n").cast("bigint").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.max(F.struct(F.col("_n").alias("freq"), (-F.col("_lead")).alias("lead"))).alias("_best"),
    )
    best = F.broadcast(best)  # one row a column of the table
    likely = counted.join(best, "column_name").where(
        (F.col("_n") == F.col("_best.freq")) & (F.col("_lead") == -F.col("_best.lead"))
    )
    likely = materialize(likely.select("column_name", "_fp", "_fp2"))
    tops = (
        may_have(long, "_fp", likely.select("_fp"), likely.count())
        .join(likely, ["column_name", "_fp", "_fp2"])  # each is there once
        .groupBy("column_name")
        .agg(F.min("value").alias("top"))
    )
    return tops.join(best, "column_name").select("column_name", "count", "unique", "top", F.col("_best.freq").alias("freq"))


def describe_columns(df: DataFrame, method: str = "exact", accuracy: int = 100_000) -> DataFrame:
    """Summary statistics per column, in column order.

    Numeric columns: count, mean, std (sample), min, 25/50/75 % (exact linear
    interpolation by narrowing ranks, one more scan; ``method='approx'`` for
    one pass), max. Other columns: count, unique, top (most frequent, ties to the
    smallest value), freq. Columns: ``column_name, position, kind, count,
    unique, top, freq, mean, std, min, p25, p50, p75, max``.
    """
    if method not in ("exact", "approx"):
        raise ValueError(f"method must be 'exact' or 'approx'; got {method!r}")
    cols = list(df.columns)
    numeric = [c for c in cols if is_numeric_type(df.schema[c].dataType)]
    text = [c for c in cols if c not in numeric]
    pos = {c: i for i, c in enumerate(cols)}
    parts = []
    null_d = F.lit(None).cast("double")
    if numeric:
        aggs = []
        for i, c in enumerate(numeric):
            x = nan_as_null(df, c).cast("double")
            aggs += [
                F.count(x).alias(f"n{i}"),
                F.avg(x).alias(f"mean{i}"),
                F.stddev_samp(x).alias(f"std{i}"),
                F.min(x).alias(f"min{i}"),
                F.max(x).alias(f"max{i}"),
            ]
            if method == "exact":
                aggs += bracket_columns(x, QUARTILES, f"b{i}_")
            else:
                aggs.append(F.percentile_approx(x, F.array(*[F.lit(p) for p in QUARTILES]), accuracy).alias(f"q{i}"))
        # One row whatever the table size: the per-column statistics.
        got = df.agg(*aggs).first()
        if method == "exact":
            # The aggregate above also brackets the quartiles; one more scan counts the values in the brackets.
            long = df.select(*[nan_as_null(df, c).cast("double").alias(c) for c in numeric]).unpivot(
                [], numeric, "column_name", "_v"
            )
            first = [
                {"_g": c} | {k: got[f"b{i}_{k}"] for k in ("n", "lo", "hi", "near")} for i, c in enumerate(numeric)
            ]
            qs = exact_quantiles(long, "column_name", "_v", QUARTILES, first=first)
        else:
            qs = {c: list(got[f"q{i}"]) for i, c in enumerate(numeric) if got[f"q{i}"] is not None}
        parts.append(
            df.sparkSession.createDataFrame(
                [
                    (
                        c, pos[c], "numeric", got[f"n{i}"], None, None, None, got[f"mean{i}"], got[f"std{i}"],
                        got[f"min{i}"], *qs.get(c, [None, None, None]), got[f"max{i}"],
                    )
                    for i, c in enumerate(numeric)
                ],
                "column_name string, position int, kind string, count bigint, unique bigint, top string, "
                "freq bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double",
            )
        )
    if text:
        per_column = _text_statistics(df, text)
        # Columns with no present value still get their row.
        spine = df.sparkSession.createDataFrame([(c,) for c in text], "column_name string")
        parts.append(
            spine.join(per_column, "column_name", "left").select(
                "column_name",
                (ordinal_in(F.col("column_name"), cols) - 1).alias("position"),
                F.lit("text").alias("kind"),
                F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
                F.coalesce(F.col("unique"), F.lit(0)).cast("bigint").alias("unique"),
                "top",
                F.col("freq").cast("bigint").alias("freq"),
                null_d.alias("mean"),
                null_d.alias("std"),
                null_d.alias("min"),
                null_d.alias("p25"),
                null_d.alias("p50"),
                null_d.alias("p75"),
                null_d.alias("max"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    stats = ["kind", "count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return out.select("column_name", F.col("position").cast("int").alias("position"), *stats).orderBy("position")


# Q18 -------------------------------------------------------------------------


@dataclass(frozen=True)
class QualityConfig:
    """What the quality report checks; every field is optional."""

    id_column: str | None = None
    exclude_categorical: tuple[str, ...] = ()
    rules: tuple[Implication, ...] = ()
    numeric_text_column: str | None = None
    minimums: Mapping[str, float] = field(default_factory=dict)
    domains: Mapping[str, Sequence] = field(default_factory=dict)
    range_columns: tuple[str, ...] = ()
    #: The column whose distribution over blank texts is told, and the context shown with affected rows per
    #: checked column (its first column orders the rows).
    blank_context_column: str | None = None
    contexts: Mapping[str, Sequence[str]] = field(default_factory=dict)


def _report_records(df: DataFrame, checks: Sequence[tuple]) -> DataFrame:
    """(check, shown): up to ten affected rows of every check, in one scan.

    A check is ``(condition, context columns)``; its first context column
    orders the rows. An affected row is told once per check it fails; each task
    keeps its own ten rows of a check before the exchange.
    """
    cols = list(dict.fromkeys(c for _, context in checks for c in context))
    place = {c: f"_c{i}" for i, c in enumerate(cols)}
    any_wrong = F.lit(False)
    for wrong, _ in checks:
        any_wrong = any_wrong | F.coalesce(wrong, F.lit(False))
    failed = F.filter(F.array(*[F.when(wrong, F.lit(i)) for i, (wrong, _) in enumerate(checks)]), lambda i: i.isNotNull())
    told = df.where(any_wrong).select(*[df[c].alias(place[c]) for c in cols], F.explode(failed).alias("check"))
    # One key for each ordering column, missing in the rows of checks that other columns order.
    keys = []
    for first in dict.fromkeys(context[0] for _, context in checks):
        own = [i for i, (_, context) in enumerate(checks) if context[0] == first]
        keys.append(F.when(F.col("check").isin(own), F.col(place[first])))
    told = told.withColumn("_rank", F.row_number().over(Window.partitionBy("check").orderBy(*keys)))
    shown = F.lit(None).cast("string")
    for i, (_, context) in enumerate(checks):
        record = F.struct(*[F.col(place[c]).alias(c) for c in context])
        shown = F.when(F.col("check") == i, F.to_json(record, {"ignoreNullFields": "false"})).otherwise(shown)
    return told.where(F.col("_rank") <= SAMPLE_SIZE).select("check", shown.alias("shown"))


def quality_report(df: DataFrame, config: QualityConfig) -> DataFrame:
    """The whole assessment in one long table, in report order (Q18).

    Columns: ``section, item, column_name, value, row_count, metric`` plus
    ``step`` for ordering. Affected records of a checked column with a context
    are shown as JSON of the context columns, up to ten each, with the number
    affected as ``row_count``.

    Every row tells numbered cells (the section and column by the number, a
    value, a number whose range is wanted), which the tasks combine before one
    shuffle: one scan for all sections. Cells that have one row whatever the
    data (counters) are collected; values stay distributed. The
    affected records take a second scan, duplicate rows and ids their own.
    """
    c = config
    checked = [*c.minimums, *c.domains, *c.range_columns, *([c.numeric_text_column] if c.numeric_text_column else [])]
    shown_columns = [x for context in c.contexts.values() for x in context]
    by = c.blank_context_column if c.numeric_text_column else None
    require_columns(df, [*checked, *shown_columns, *([by] if by else []), *[x for r in c.rules for x in (r.trigger, *r.dependents)]])
    profiled = categorical_columns(df, c.exclude_categorical)
    names: dict[tuple, int] = {}
    cells: list[Column] = []

    def cell(name: tuple, when: Column | None = None, value: Column | None = None, number: Column | None = None) -> None:
        told = F.struct(
            F.lit(names.setdefault(name, len(names))).alias("cell"),
            (F.lit(None) if value is None else value).cast("string").alias("value"),
            (F.lit(None) if number is None else number).cast("double").alias("number"),
        )
        cells.append(told if when is None else F.when(when, told))

    cell(("rows",))
    for col in df.columns:
        if col in profiled:  # its missing rows are those of the missing value
            cell(("profile", col), value=nan_as_null(df, col))
        else:
            cell(("missing", col), _missing(df, col))
    for i, r in enumerate(c.rules):
        fired = F.coalesce(df[r.trigger] == F.lit(r.trigger_value), F.lit(False))
        cell(("trigger", i), fired)
        any_bad = F.lit(False)
        for d in r.dependents:
            any_bad = any_bad | _violation(df, r, d)
            cell(("violation", i, d), fired & _violation(df, r, d), df[d])
        cell(("violating", i), fired & any_bad)
    if c.numeric_text_column:
        cls = readability_class(nan_as_null(df, c.numeric_text_column))
        cell(("readability",), value=cls)
        if by:
            cell(("blank",), (cls == "blank") & nan_as_null(df, by).isNotNull(), row_key(df, by))
    for col, mn in c.minimums.items():
        x = nan_as_null(df, col)
        cell(("minimum", col), x.isNotNull(), number=x)
        cell(("below", col), x < F.lit(mn))
        cell(("below_value", col), x < F.lit(mn), row_key(df, col))
    for col, vals in c.domains.items():
        outside = ~in_values(nan_as_null(df, col), list(vals))
        cell(("outside", col), outside)
        cell(("outside_value", col), outside, row_key(df, col))
    for col in c.range_columns:
        x = nan_as_null(df, col)
        cell(("range", col), x.isNotNull(), number=x)

    counted = materialize(
        df.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("c"))
        .groupBy("c.cell", "c.value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("c.number").alias("low"), F.max("c.number").alias("high"))
    )
    # One row a counter and class, and one a column that has missing values.
    valued = ("profile", "violation", "blank", "below_value", "outside_value")
    counters = [i for name, i in names.items() if name[0] not in valued]
    got = {
        (r["cell"], r["value"]): r
        for r in counted.where(F.col("cell").isin(counters) | F.col("value").isNull()).collect()
    }

    def found(name: tuple, value: str | None = None, what: str = "n"):
        r = got.get((names[name], value))
        return r[what] if r is not None else (0 if what == "n" else None)

    rows = found(("rows",))
    lines: list[tuple] = [
        (0, "shape", "rows", None, None, rows, None),
        (0, "shape", "columns", None, None, len(df.columns), None),
    ]
    for col in df.columns:
        n = found(("profile" if col in profiled else "missing", col))
        lines.append((2, "missing", "missing_values", col, None, n, n / rows * 100.0 if rows else None))
    for i, r in enumerate(c.rules):
        bad = float(found(("violating", i)))
        lines.append((4, "implication", r.name, r.trigger, str(r.trigger_value), found(("trigger", i)), bad))
    if c.numeric_text_column:
        for k in READABILITY_CLASSES:
            lines.append((5, "readability", k, c.numeric_text_column, None, found(("readability",), k), None))
    for col, mn in c.minimums.items():
        lines.append((6, "below_minimum", "observed_min", col, None, None, found(("minimum", col), what="low")))
        lines.append((6, "below_minimum", "below_count", col, None, found(("below", col)), float(mn)))
    for col in c.domains:
        lines.append((7, "outside_domain", "outside_count", col, None, found(("outside", col)), None))
    for col in c.range_columns:
        lines.append((8, "range", "missing_count", col, None, rows - found(("range", col)), None))
        lines.append((8, "range", "observed_min", col, None, None, found(("range", col), what="low")))
        lines.append((8, "range", "observed_max", col, None, None, found(("range", col), what="high")))

    spark = df.sparkSession
    head = "step int, section string, item string, column_name string"
    columns = ["step", "section", "item", "column_name", "value", "row_count", "metric"]
    out = spark.createDataFrame(lines, f"{head}, value string, row_count bigint, metric double")

    places = []
    for name, i in names.items():
        if name[0] == "profile":
            places.append((i, 3, "categorical_profile", "value_count", name[1]))
        elif name[0] == "violation":
            places.append((i, 4, "implication_violation", c.rules[name[1]].name, name[2]))
        elif name[0] == "blank":
            places.append((i, 5, "blank_context", by, c.numeric_text_column))
        elif name[0] == "below_value":
            places.append((i, 6, "below_minimum", "value_count", name[1]))
        elif name[0] == "outside_value":
            places.append((i, 7, "outside_domain", "value_count", name[1]))
    if places:  # one small row a cell
        of_rows = F.when(F.col("step") == 3, percent(F.col("n"), F.lit(rows)))
        values = counted.join(F.broadcast(spark.createDataFrame(places, f"cell int, {head}").coalesce(1)), "cell")
        out = out.unionByName(values.withColumns({"row_count": F.col("n"), "metric": of_rows}).select(*columns))

    checks, told = [], []
    if c.numeric_text_column and c.contexts.get(c.numeric_text_column):
        unreadable = readability_class(nan_as_null(df, c.numeric_text_column)) != "convertible"
        checks.append((unreadable, list(c.contexts[c.numeric_text_column])))
        told.append((5, "readability", c.numeric_text_column, rows - found(("readability",), "convertible")))
    for col, mn in c.minimums.items():
        if c.contexts.get(col):
            checks.append((nan_as_null(df, col) < F.lit(mn), list(c.contexts[col])))
            told.append((6, "below_minimum", col, found(("below", col))))
    for col, vals in c.domains.items():
        if c.contexts.get(col):
            checks.append((~in_values(nan_as_null(df, col), list(vals)), list(c.contexts[col])))
            told.append((7, "outside_domain", col, found(("outside", col))))
    wanted = [k for k, t in enumerate(told) if t[3]]
    if wanted:
        places = [(i, step, section, "affected_record", col, n) for i, (step, section, col, n) in enumerate(told[k] for k in wanted)]
        places = spark.createDataFrame(places, f"check int, {head}, row_count bigint").coalesce(1)
        records = _report_records(df, [checks[k] for k in wanted]).join(F.broadcast(places), "check")
        records = records.withColumnRenamed("shown", "value").withColumn("metric", F.lit(None).cast("double"))
        out = out.unionByName(records.select(*columns))

    repeats = [("duplicate_rows", None, count_duplicate_rows(df))]
    if c.id_column:
        repeats.append(("duplicate_ids", c.id_column, count_duplicate_ids(df, c.id_column)))
    for item, col, frame in repeats:
        line = [F.lit(1), F.lit("duplicates"), F.lit(item), F.lit(col).cast("string"), F.lit(None).cast("string"), F.col(item)]
        line.append(F.lit(None).cast("double"))
        out = out.unionByName(frame.select(*[x.alias(name) for x, name in zip(line, columns)]))
    return out.orderBy("step", "section", "item", F.asc_nulls_first("column_name"), F.desc_nulls_last("row_count"), "value")
