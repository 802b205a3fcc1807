"""The operators: DataFrame in, DataFrame out."""

from segstats.operators.dist import (
    box_plot_fliers,
    box_plot_stats,
    distribution_by_label,
    histogram_by_label,
    observed_range,
    population_observations,
    shared_bin_edges,
)
from segstats.operators.quality import (
    Implication,
    QualityConfig,
    affected_sample,
    below_minimum,
    below_minimum_values,
    categorical_columns,
    categorical_profile,
    class_context,
    count_duplicate_ids,
    count_duplicate_rows,
    describe_columns,
    domain_conformance,
    implication_support,
    implication_violations,
    missing_by_column,
    numeric_readability,
    outside_domain,
    outside_domain_count,
    product_residual,
    quality_report,
    range_profile,
    readability_sample,
    schema_profile,
    table_shape,
)
from segstats.operators.roles import Roles, require_columns, validate_roles
from segstats.operators.segments import (
    rate_by_value,
    reconcile_slice,
    retention_baseline,
    segment_rates,
    slice_vs_baseline,
    status_table,
)

__all__ = [name for name in dir() if not name.startswith("_")]
