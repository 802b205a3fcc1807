"""Outcome rates per segment, per observed value and inside a range.

All operators are one aggregation over the pruned input columns:

* global conditional counts (R2, R7) are a single-row aggregate: partial
  counts per scan task, no shuffle of rows;
* grouped rates (R3, R4, R10) are ``groupBy().agg()`` with map-side partial
  aggregation, so a hot key (one segment holding a third of the rows) is
  collapsed to one partial row per task before the shuffle;
* expected categories that must appear even when empty are unioned in as
  zero-weight rows *before* the aggregation instead of being outer-joined
  afterwards: one shuffle, no join.

Rates in R2-R4 are percents, in R7 and R10 proportions. An empty denominator
gives NULL (undefined), never 0, except the retention percents of an empty
frame, which are 0.0 as in the reference report.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.functions.exprs import (
    field_type,
    in_values,
    is_numeric_type,
    label_text,
    nan_as_null,
    ordinal_in,
    percent,
    ratio,
)
from segstats.operators.materialize import materialize
from segstats.operators.roles import bad_label, refuse_roles, require_columns

# --- Fixed values: status names of the reference reports ---------------------
RETAINED_LABEL = "Retained"
CHURNED_LABEL = "Churned"
MISSING_LABEL = "Missing target value"
UNEXPECTED_LABEL_FORMAT = 'Unexpected: "{}"'
TOTAL_LABEL = "Total"
EXPECTED_STATUS = "expected"
UNEXPECTED_STATUS = "unexpected"
MISSING_STATUS = "missing"
# -----------------------------------------------------------------------------


def _zero_weight_rows(df: DataFrame, column: str, values: Sequence, dtype: str) -> DataFrame:
    """One row per value with weight 0, to be unioned before an aggregation."""
    spark = df.sparkSession
    # A handful of rows: one partition, so the union adds one task, not one per core.
    return spark.createDataFrame([(v,) for v in values], f"{column} {dtype}").coalesce(1).select(
        F.col(column), F.lit(0).alias("_w")
    )


# R10 -------------------------------------------------------------------------


def rate_by_value(
    df: DataFrame,
    measure: str = "tenure",
    label: str = "Churn",
    positive: str = "Yes",
    negative: str = "No",
    value_name: str = "tenure_month",
) -> DataFrame:
    """One row per observed measure value, ascending, with its outcome rate.

    Columns: ``<value_name>, customer_count, churned_count, retained_count,
    churn_rate`` (a proportion). Rows with a missing measure enter no row; no
    value is invented for gaps. Refuses (``ValueError``) unexpected labels, a
    non-numeric measure, and any row with a measure but no label.

    Plan: ONE scan of the input, aggregated per value (map-side partial
    aggregation, one shuffle on the value) together with the refusal counters,
    and written once to the shared checkpoint folder. The refusals and the
    result both read that small per-value table; no second shuffle.
    """
    require_columns(df, [measure, label])
    numeric = is_numeric_type(field_type(df, measure))
    lab = label_text(df, label)
    per_value = materialize(
        df.groupBy(nan_as_null(df, measure).alias(value_name)).agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.count_if(lab == positive).alias("churned_count"),
            F.count_if(lab == negative).alias("retained_count"),
            F.count_if(lab.isNull()).alias("_no_label"),
            F.count_if(bad_label(lab, (negative, positive))).alias("_bad_labels"),
        )
    )
    v = F.col(value_name)
    checks = [
        F.sum("customer_count").alias("row_count"),
        F.sum("_bad_labels").alias("bad_labels"),
        F.sum(F.when(v.isNotNull(), F.col("_no_label")) if numeric else F.lit(0)).alias("unclassified"),
    ]
    counts = {k: int(x or 0) for k, x in per_value.agg(*checks).first().asDict().items()}
    refuse_roles(df, label, measure, (negative, positive), counts, df.select(lab.alias("_label")), "_label")
    if counts["unclassified"]:
        raise ValueError(
            f"{counts['unclassified']} row(s) with a '{measure}' have no recorded '{label}' value, so their rate is unknown."
        )
    return (
        per_value.where(v.isNotNull())
        .select(
            value_name,
            "customer_count",
            "churned_count",
            "retained_count",
            ratio(F.col("churned_count"), F.col("customer_count")).alias("churn_rate"),
        )
        .orderBy(value_name)
    )


# R7 - R9 ----------------------------------------------------------------------


def slice_vs_baseline(
    df: DataFrame,
    low: float = 0,
    high: float = 6,
    measure: str = "tenure",
    label: str = "Churn",
    positive: str = "Yes",
    negative: str = "No",
) -> DataFrame:
    """One row comparing the outcome rate inside ``low..high`` (inclusive) with the whole table.

    13 columns: bounds, slice counts, slice rate, population share, churn
    contribution, overall counts and rate, rate difference and relative rate.
    A missing or out-of-range measure is outside the slice but inside the
    overall counts. Refuses a slice row without a label (R9).

    Plan: the refusal counters and the result counters are ONE global
    aggregate (one scan, one partial row per task, no shuffle of rows); its
    single row is checkpointed, checked, and turned into the result.
    """
    require_columns(df, [measure, label])
    numeric = is_numeric_type(field_type(df, measure))
    lab = label_text(df, label)
    # A text measure is refused below whenever rows exist; it is never compared.
    in_slice = nan_as_null(df, measure).between(low, high) if numeric else F.lit(False)
    totals = materialize(
        df.agg(
            F.count(F.lit(1)).alias("overall_customer_count"),
            F.count_if(bad_label(lab, (negative, positive))).alias("_bad_labels"),
            F.count_if(in_slice & lab.isNull()).alias("_unclassified"),
            F.count_if(in_slice).alias("slice_customer_count"),
            F.count_if(in_slice & (lab == positive)).alias("slice_churned_count"),
            F.count_if(in_slice & (lab == negative)).alias("slice_retained_count"),
            F.count_if(lab == positive).alias("overall_churned_count"),
        )
    )
    got = totals.first()
    counts = {"row_count": got["overall_customer_count"], "bad_labels": got["_bad_labels"]}
    refuse_roles(df, label, measure, (negative, positive), counts, df.select(lab.alias("_label")), "_label")
    if got["_unclassified"]:
        raise ValueError(
            f"{got['_unclassified']} row(s) from {low} to {high} have no recorded '{label}' value, so the rate is unknown."
        )
    slice_rate = ratio(F.col("slice_churned_count"), F.col("slice_customer_count"))
    overall_rate = ratio(F.col("overall_churned_count"), F.col("overall_customer_count"))
    return totals.select(
        F.lit(low).alias("slice_min_tenure"),
        F.lit(high).alias("slice_max_tenure"),
        "slice_customer_count",
        "slice_churned_count",
        "slice_retained_count",
        slice_rate.alias("slice_churn_rate"),
        ratio(F.col("slice_customer_count"), F.col("overall_customer_count")).alias(
            "slice_population_share"
        ),
        ratio(F.col("slice_churned_count"), F.col("overall_churned_count")).alias(
            "slice_churn_contribution"
        ),
        "overall_customer_count",
        "overall_churned_count",
        overall_rate.alias("overall_churn_rate"),
        (slice_rate - overall_rate).alias("rate_difference"),
        ratio(slice_rate, overall_rate).alias("relative_churn_rate"),
    )


# R13 -------------------------------------------------------------------------


def reconcile_slice(month_rates: DataFrame, slice_row: DataFrame, value_name: str = "tenure_month") -> DataFrame:
    """Check that the per-value rows inside the slice add up to the slice counts.

    ``month_rates`` is an R10 result, ``slice_row`` an R7 result. The slice is
    attached as one scalar struct subquery (a single value, reused), not by a
    join. Returns one row with both sets of counts and ``reconciles``.
    """
    s = slice_row.select(
        F.struct(
            "slice_min_tenure",
            "slice_max_tenure",
            "slice_customer_count",
            "slice_churned_count",
            "slice_retained_count",
        )
    ).scalar()
    inside = month_rates.where(F.col(value_name).between(s["slice_min_tenure"], s["slice_max_tenure"]))
    sums = inside.agg(
        F.coalesce(F.sum("customer_count"), F.lit(0)).cast("bigint").alias("value_customer_count"),
        F.coalesce(F.sum("churned_count"), F.lit(0)).cast("bigint").alias("value_churned_count"),
        F.coalesce(F.sum("retained_count"), F.lit(0)).cast("bigint").alias("value_retained_count"),
    )
    return sums.select(
        "value_customer_count",
        "value_churned_count",
        "value_retained_count",
        s["slice_customer_count"].alias("slice_customer_count"),
        s["slice_churned_count"].alias("slice_churned_count"),
        s["slice_retained_count"].alias("slice_retained_count"),
        (
            (F.col("value_customer_count") == s["slice_customer_count"])
            & (F.col("value_churned_count") == s["slice_churned_count"])
            & (F.col("value_retained_count") == s["slice_retained_count"])
        ).alias("reconciles"),
    )


# R2 --------------------------------------------------------------------------


def retention_baseline(
    df: DataFrame, label: str = "Churn", positive: str = "Yes", negative: str = "No"
) -> DataFrame:
    """One row of label counts: the retention vs. churn baseline (R2).

    Columns: ``total_customers, retained_count, churned_count, missing_count,
    unexpected_count, retained_percent, churned_percent,
    retained_minus_churned, retained_minus_churned_percent,
    has_unexpected_values``. Percents are of all rows and 0.0 for no rows.
    """
    require_columns(df, [label])
    lab = label_text(df, label)
    expected = in_values(lab, (negative, positive))
    t = df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(lab == negative).alias("retained_count"),
        F.count_if(lab == positive).alias("churned_count"),
        F.count_if(lab.isNull()).alias("missing_count"),
        F.count_if(lab.isNotNull() & ~expected).alias("unexpected_count"),
    )

    def pct(c: str):
        return F.coalesce(percent(F.col(c), F.col("total_customers")), F.lit(0.0))

    return t.select(
        "total_customers",
        "retained_count",
        "churned_count",
        "missing_count",
        "unexpected_count",
        pct("retained_count").alias("retained_percent"),
        pct("churned_count").alias("churned_percent"),
        (F.col("retained_count") - F.col("churned_count")).alias("retained_minus_churned"),
        (pct("retained_count") - pct("churned_count")).alias("retained_minus_churned_percent"),
        ((F.col("missing_count") > 0) | (F.col("unexpected_count") > 0)).alias("has_unexpected_values"),
    )


# R3 --------------------------------------------------------------------------


def status_table(
    df: DataFrame,
    label: str = "Churn",
    positive: str = "Yes",
    negative: str = "No",
    with_total: bool = True,
) -> DataFrame:
    """One row per label status with its count and percent of all rows.

    Order: Retained, Churned (always present), each unexpected value as
    ``Unexpected: "v"`` (most frequent first), ``Missing target value`` (only
    when some label is missing), then ``Total`` (100 %). Columns:
    ``status, customer_count, percent``. One scan: the total is the sum of the
    per-status counts, and its plan reuses their exchange.
    """
    require_columns(df, [label])
    lab = label_text(df, label)
    rows = df.select(lab.alias("_value"), F.lit(1).alias("_w")).unionByName(
        _zero_weight_rows(df, "_value", (negative, positive), "string")
    )
    per_value = rows.groupBy("_value").agg(F.sum("_w").cast("bigint").alias("customer_count"))
    total = per_value.groupBy().agg(F.sum("customer_count").alias("n")).scalar()
    v = F.col("_value")
    rank = (
        F.when(v == negative, F.lit(0))
        .when(v == positive, F.lit(1))
        .when(v.isNull(), F.lit(3))
        .otherwise(F.lit(2))
    )
    status = (
        F.when(v == negative, F.lit(RETAINED_LABEL))
        .when(v == positive, F.lit(CHURNED_LABEL))
        .when(v.isNull(), F.lit(MISSING_LABEL))
        .otherwise(F.format_string(UNEXPECTED_LABEL_FORMAT.replace("{}", "%s"), v))
    )
    body = per_value.select(
        status.alias("status"),
        "customer_count",
        F.coalesce(percent(F.col("customer_count"), total), F.lit(0.0)).alias("percent"),
        rank.alias("_rank"),
        v,
    )
    if with_total:
        body = body.unionByName(
            df.sparkSession.range(0, 1, 1, 1).select(
                F.lit(TOTAL_LABEL).alias("status"),
                total.cast("bigint").alias("customer_count"),
                F.lit(100.0).alias("percent"),
                F.lit(4).alias("_rank"),
                F.lit(None).cast("string").alias("_value"),
            )
        )
    ordered = body.orderBy("_rank", F.desc("customer_count"), F.asc_nulls_last("_value"))
    return ordered.select(
        "status",
        "customer_count",
        "percent",
    )


# R4 - R6 ----------------------------------------------------------------------


def segment_rates(
    df: DataFrame,
    baseline_percent: float,
    segment: str = "Contract",
    expected: Sequence[str] = ("Month-to-month", "One year", "Two year"),
    label: str = "Churn",
    positive: str = "Yes",
    value_name: str = "contract",
) -> DataFrame:
    """Outcome rate per segment value against a supplied baseline percent.

    Columns: ``<value_name>, value_status, customer_count, churned_count,
    churn_rate_percent, difference_percentage_points``. Every expected value
    has a row (zero counts and NULL rate when empty); other present values are
    ``unexpected`` and NULL segments form one ``missing`` row (only if any).
    Rows partition the input. Every label other than ``positive`` counts as
    not churned, unchecked. Order (R5): expected in domain order, unexpected
    by count descending, missing last.
    """
    require_columns(df, [segment, label])
    try:
        baseline = float(baseline_percent)
    except (TypeError, ValueError):
        baseline = math.nan
    if not 0 <= baseline <= 100:  # NaN fails too (R6)
        raise ValueError(f"{baseline_percent!r} is no baseline percent: give a number between 0 and 100.")
    # Segment values compare as text, like labels (an integer 1 matches "1").
    expected = tuple(str(v) for v in expected)
    seg = label_text(df, segment)
    lab = label_text(df, label)
    churned = F.coalesce((lab == positive).cast("int"), F.lit(0))
    rows = df.select(seg.alias("_segment"), F.lit(1).alias("_w"), churned.alias("_churned")).unionByName(
        _zero_weight_rows(df, "_segment", expected, "string").withColumn("_churned", F.lit(0))
    )
    per_value = rows.groupBy("_segment").agg(
        F.sum("_w").cast("bigint").alias("customer_count"),
        F.sum("_churned").cast("bigint").alias("churned_count"),
    )
    s = F.col("_segment")
    status = (
        F.when(s.isNull(), F.lit(MISSING_STATUS))
        .when(in_values(s, expected), F.lit(EXPECTED_STATUS))
        .otherwise(F.lit(UNEXPECTED_STATUS))
    )
    rank = F.when(s.isNull(), F.lit(2)).when(in_values(s, expected), F.lit(0)).otherwise(F.lit(1))
    rate = percent(F.col("churned_count"), F.col("customer_count"))
    return (
        per_value.select(
            s.alias(value_name),
            status.alias("value_status"),
            "customer_count",
            "churned_count",
            rate.alias("churn_rate_percent"),
            (rate - F.lit(baseline)).alias("difference_percentage_points"),
            rank.alias("_rank"),
            ordinal_in(s, expected).alias("_ordinal"),
        )
        .orderBy("_rank", "_ordinal", F.desc("customer_count"), F.asc(value_name))
        .drop("_rank", "_ordinal")
    )
