"""Column roles and the input refusal shared by the label/measure analyses.

The refusal must be a ``ValueError`` raised when the operator is called, so it
is the one place where an operator runs a job eagerly. Every check that needs
data is fused into a single global aggregate over the pruned columns: a
one-row result whatever the table size, with a partial aggregate per scan
task and no shuffle of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.functions.exprs import field_type, in_values, is_numeric_type, label_text

# How many distinct offending labels a refusal message quotes.
EXAMPLE_LIMIT = 10


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in an analysis."""

    label: str = "Churn"
    measure: str = "tenure"
    positive: str = "Yes"
    negative: str = "No"

    @property
    def expected_labels(self) -> tuple[str, str]:
        """Both populations, in reporting order: retained first, then churned."""
        return (self.negative, self.positive)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Refuse when a required column is absent (schema only, no job)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(
            f"Required column absent: {', '.join(missing)} (the input has {', '.join(df.columns) or 'no columns'})"
        )


def bad_label(lab: Column, expected_labels: Sequence[str]) -> Column:
    """A present label outside the expected values (exact, case-sensitive text)."""
    return lab.isNotNull() & ~in_values(lab, expected_labels)


def refuse_roles(
    df: DataFrame,
    label: str,
    measure: str,
    expected_labels: Sequence[str],
    counts: Mapping[str, int],
    examples: DataFrame,
    example_column: str,
) -> None:
    """Raise the R1 refusals, in order, from already computed counts.

    ``counts`` holds ``row_count`` and ``bad_labels``; ``examples`` is any
    DataFrame whose ``example_column`` holds the label text, read only when a
    refusal needs to quote offending values: the first few of the distinct
    ones, with how many there are.
    """
    if counts["bad_labels"]:
        c = F.col(example_column)
        wrong = examples.where(bad_label(c, expected_labels)).select(c.alias("v")).distinct()
        total = wrong.count()
        quoted = [r[0] for r in wrong.orderBy("v").limit(EXAMPLE_LIMIT).collect()]
        which = f"{len(quoted)} of {total} distinct: " if total > len(quoted) else ""
        raise ValueError(
            f"{counts['bad_labels']} row(s) have a '{label}' outside {' / '.join(map(repr, expected_labels))} "
            f"({which}{', '.join(map(repr, quoted))}) and belong to neither group."
        )
    if counts["row_count"] > 0 and not is_numeric_type(field_type(df, measure)):
        kind = field_type(df, measure).simpleString()
        raise ValueError(f"'{measure}' has type {kind}; a numeric measure is needed.")


def validate_roles(
    df: DataFrame,
    label: str,
    measure: str,
    expected_labels: Sequence[str],
    counters: Mapping[str, Column] | None = None,
) -> dict[str, int]:
    """Refuse input the label/measure analyses cannot classify.

    Checks, in this order: (1) both columns exist; (2) no present label lies
    outside ``expected_labels`` (exact, case-sensitive text comparison);
    (3) the measure is numeric and not boolean, unless the frame has no rows.

    ``counters`` are extra boolean conditions counted in the same aggregate, so
    an operator's own integrity checks cost no additional scan. They are only
    evaluated on a numeric measure. Returns the row count and every counter.
    Operators that also need an aggregate of the input compute these counts
    from that aggregate instead (see ``refuse_roles``), scanning it once.
    """
    require_columns(df, [measure, label])
    numeric = is_numeric_type(field_type(df, measure))
    lab = label_text(df, label)
    aggs = [F.count(F.lit(1)).alias("row_count"), F.count_if(bad_label(lab, expected_labels)).alias("bad_labels")]
    extra = dict(counters or {}) if numeric else {}
    aggs += [F.count_if(cond).alias(name) for name, cond in extra.items()]
    counts = {k: int(v) for k, v in df.agg(*aggs).first().asDict().items()}
    refuse_roles(df, label, measure, expected_labels, counts, df.select(lab.alias("_label")), "_label")
    return counts
