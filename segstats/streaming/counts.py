"""Running outcome counts over a streaming DataFrame.

A stream cannot be refused at call time the way a static table is, so the
refusal conditions of R10 become counters in the output (``unclassified_count``,
``unexpected_label_count``) that the consumer checks. State is one row per
distinct value (per segment), updated with partial aggregation per
micro-batch; run with output mode ``complete`` or ``update``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.functions.exprs import label_text, nan_as_null, ratio
from segstats.operators.roles import bad_label, require_columns


def stream_rate_by_value(
    stream: DataFrame,
    measure: str = "tenure",
    label: str = "Churn",
    positive: str = "Yes",
    negative: str = "No",
    value_name: str = "tenure_month",
) -> DataFrame:
    """R10's per-value counts and rate, maintained over a stream."""
    require_columns(stream, [measure, label])
    m = nan_as_null(stream, measure)
    lab = label_text(stream, label)
    return (
        stream.where(m.isNotNull())
        .groupBy(m.alias(value_name))
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.count_if(lab == positive).alias("churned_count"),
            F.count_if(lab == negative).alias("retained_count"),
            F.count_if(lab.isNull()).alias("unclassified_count"),
            F.count_if(bad_label(lab, (negative, positive))).alias("unexpected_label_count"),
        )
        .withColumn("churn_rate", ratio(F.col("churned_count"), F.col("customer_count")))
    )


def stream_segment_counts(
    stream: DataFrame, segment: str = "Contract", label: str = "Churn", positive: str = "Yes", value_name: str = "contract"
) -> DataFrame:
    """R4's per-segment counts (missing segment as its own NULL group), maintained over a stream."""
    require_columns(stream, [segment, label])
    lab = label_text(stream, label)
    return stream.groupBy(label_text(stream, segment).alias(value_name)).agg(
        F.count(F.lit(1)).alias("customer_count"), F.count_if(lab == positive).alias("churned_count")
    )
