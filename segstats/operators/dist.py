"""Distribution summaries per population.

A *population* is the set of rows whose label equals one of the expected
values (retained ``No`` and churned ``Yes`` by default). Rows with another or
a missing label belong to no population.

Plan shape: every statistic is a ``groupBy(population).agg()``. Counts, mean,
min and max are algebraic (map-side partial aggregation, so the few hot
population keys are collapsed per task before the shuffle). Exact quartiles
(linear interpolation) come from ``quantiles.exact_quantiles``: the first scan
also brackets their ranks, a second one counts the values in the brackets, and
no copy of the input is written. ``method="approx"`` uses ``percentile_approx``
(rank error ``1/accuracy``) in a single pass.

Empty populations still get their row. Per-population fences are attached by a
broadcast join whose right side has one row per expected population.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from segstats.functions.exprs import field_type, in_values, is_numeric_type, label_text, nan_as_null, ordinal_in
from segstats.operators.materialize import materialize
from segstats.operators.quantiles import bracket_columns, exact_quantiles, quantiles_and_cells
from segstats.operators.roles import bad_label, refuse_roles, require_columns

DEFAULT_POPULATIONS = ("No", "Yes")
QUARTILES = (0.25, 0.5, 0.75)
DEFAULT_ACCURACY = 100_000


def _check_method(method: str) -> None:
    if method not in ("exact", "approx"):
        raise ValueError(f"method must be 'exact' or 'approx'; got {method!r}")


def _quartile_columns(m: Column, method: str, accuracy: int) -> list[Column]:
    """What an aggregate per population must hold for its quartiles."""
    if method == "approx":
        return [F.percentile_approx(m, F.array(*map(F.lit, QUARTILES)), accuracy).alias("_q")]
    return bracket_columns(m, QUARTILES)


def _quartiles(rows: DataFrame, status: str, got: Sequence[dict], method: str) -> dict[object, list]:
    """Quartiles per population from the aggregate's rows (``_g`` and the columns above)."""
    if method == "approx":
        return {r["_g"]: list(r["_q"]) for r in got if r["_q"] is not None}
    return exact_quantiles(rows, status, "_m", QUARTILES, first=got)


def _population_rows(df: DataFrame, measure: str, label: str, populations: Sequence[str], status: str) -> DataFrame:
    """(status, _m) for rows inside a population; the measure as double, NaN as NULL."""
    m = nan_as_null(df, measure).cast("double")
    lab = label_text(df, label)
    # In a filter NULL drops the row like false does, so plain IN (pushed to the scan) suffices.
    return df.select(lab.alias(status), m.alias("_m")).where(F.col(status).isin(list(populations)))


# D1 --------------------------------------------------------------------------


def distribution_by_label(
    df: DataFrame,
    measure: str = "tenure",
    label: str = "Churn",
    populations: Sequence[str] = DEFAULT_POPULATIONS,
    method: str = "exact",
    accuracy: int = DEFAULT_ACCURACY,
    name: str = "tenure",
    status: str = "churn_status",
) -> DataFrame:
    """Describe the measure inside each population, one row per population in order.

    Columns: ``churn_status, customer_count, missing_<name>_count,
    valid_<name>_count, mean_<name>, median_<name>, q1_<name>, q3_<name>,
    iqr_<name>, min_<name>, max_<name>``; statistics are doubles and NULL for
    a population with no valid value. Refuses unexpected labels and a
    non-numeric measure (R1).

    Plan: one scan aggregates per population (and one group for all other
    labels) the refusal counters, the counts and the ends, and brackets the
    quartiles; a bounded collect of at most one row per population plus one.
    ``exact`` takes one more scan of the two columns, which counts the values
    in the brackets (see ``exact_quantiles``).
    """
    require_columns(df, [measure, label])
    _check_method(method)
    numeric = is_numeric_type(field_type(df, measure))
    lab = label_text(df, label)
    # A text measure is refused whenever rows exist; it is never cast.
    m = nan_as_null(df, measure).cast("double") if numeric else F.lit(None).cast("double")
    st, mv = F.col(status), F.col("_m")
    rows = df.select(lab.alias(status), m.alias("_m"))
    got = [
        r.asDict()
        for r in rows.groupBy(F.when(in_values(st, populations), st).alias("_g"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(bad_label(st, populations)).alias("bad"),
            F.count(mv).alias("valid"),
            F.avg(mv).alias("mean"),
            F.min(mv).alias("least"),
            F.max(mv).alias("most"),
            *_quartile_columns(mv, method, accuracy),
        )
        .collect()
    ]
    counts = {"row_count": sum(r["total"] for r in got), "bad_labels": sum(r["bad"] for r in got)}
    refuse_roles(df, label, measure, populations, counts, rows, status)
    got = [r for r in got if r["_g"] is not None]
    quart = _quartiles(rows.where(st.isin(list(populations))), status, got, method)
    by = {r["_g"]: r for r in got}
    out = []
    for p in populations:
        r = by.get(p, {"total": 0, "valid": 0, "mean": None, "least": None, "most": None})
        q1, median, q3 = quart.get(p, [None] * 3)
        iqr = None if q1 is None else q3 - q1
        out.append(
            (p, r["total"], r["total"] - r["valid"], r["valid"], r["mean"], median, q1, q3, iqr, r["least"], r["most"])
        )
    names = ["mean", "median", "q1", "q3", "iqr", "min", "max"]
    return df.sparkSession.createDataFrame(
        out,
        f"`{status}` string, customer_count bigint, `missing_{name}_count` bigint, `valid_{name}_count` bigint, "
        + ", ".join(f"`{n}_{name}` double" for n in names),
    )


# D2 --------------------------------------------------------------------------


def population_observations(
    df: DataFrame,
    measure: str = "tenure",
    label: str = "Churn",
    populations: Sequence[str] = DEFAULT_POPULATIONS,
    status: str = "churn_status",
) -> DataFrame:
    """The raw, non-missing observations of every population (D2). Stays distributed."""
    return _observations(df, measure, label, populations, status).withColumnRenamed("_m", measure)


def _observations(df, measure, label, populations, status) -> DataFrame:
    require_columns(df, [measure, label])
    # The plain IS NOT NULL on the stored column reaches the scan; the NaN test stays above it.
    return _population_rows(df.where(df[measure].isNotNull()), measure, label, populations, status).where(
        F.col("_m").isNotNull()
    )


# D3 --------------------------------------------------------------------------


def observed_range(
    df: DataFrame,
    measure: str = "tenure",
    label: str = "Churn",
    populations: Sequence[str] = DEFAULT_POPULATIONS,
    status: str = "churn_status",
) -> DataFrame:
    """Per population: plotted observation count and range, plus the shared range (D3)."""
    obs = _observations(df, measure, label, populations, status)
    # One scan; the result has one row per expected population, so it is collected
    # (bounded) and the shared range is taken across those rows.
    per = {
        r[status]: r
        for r in obs.groupBy(status)
        .agg(
            F.count(F.lit(1)).alias("observation_count"),
            F.min("_m").alias("population_min"),
            F.max("_m").alias("population_max"),
        )
        .collect()
    }
    mins = [r["population_min"] for r in per.values() if r["population_min"] is not None]
    maxs = [r["population_max"] for r in per.values() if r["population_max"] is not None]
    lo, hi = (min(mins) if mins else None), (max(maxs) if maxs else None)
    return df.sparkSession.createDataFrame(
        [
            (p, per[p]["observation_count"], per[p]["population_min"], per[p]["population_max"], lo, hi)
            if p in per
            else (p, 0, None, None, lo, hi)
            for p in populations
        ],
        f"`{status}` string, observation_count bigint, population_min double, population_max double, "
        "range_min double, range_max double",
    )


# D4 --------------------------------------------------------------------------


def _check_width(width: float) -> float:
    if not width > 0:
        raise ValueError(f"width must be positive; got {width}")
    return float(width)


#: Bins are numbered by whole doubles below this, so that an edge is one product.
_MOST = 2**53


def _bin(value: float, width: float) -> int:
    """The number k of the bin whose edges ``k * width`` and ``(k + 1) * width`` enclose a value."""
    k = math.floor(value / width)
    return k - 1 if value < k * width else k + 1 if value >= (k + 1) * width else k


def _bin_column(value: Column, width: float) -> Column:
    """``_bin`` as a column: exact against the edges, whatever the rounding of the division."""
    w = F.lit(width)
    most = F.lit(float(_MOST))  # values beyond it, infinities too, are refused once the range is known
    k = F.floor(F.greatest(F.least(value / w, most), -most))
    return F.when(value < k * w, k - 1).when(value >= (k + 1) * w, k + 1).otherwise(k)


def _bars(low: float | None, high: float | None, width: float) -> tuple[int, int]:
    """Number of the first bin and how many bars there are for an observed range."""
    if low is None:
        return 0, 1
    if not (math.isfinite(low) and math.isfinite(high)):
        raise ValueError(f"no histogram over an infinite range: {low} to {high}")
    if max(abs(low), abs(high)) / width >= _MOST:
        raise ValueError(f"width {width} is too small for values from {low} to {high}")
    first, last = _bin(low, width), _bin(high, width)
    # The last bar is closed: a maximum on an edge belongs to the bar below it.
    return first, max(last - first + (high > last * width), 1)


def _numbers(df: DataFrame, count: int, name: str) -> DataFrame:
    """0 to ``count - 1``, spread over more partitions the more there are."""
    return df.sparkSession.range(0, count, 1, 1 + count // 1_000_000).select(F.col("id").alias(name))


def shared_bin_edges(
    df: DataFrame,
    measure: str = "tenure",
    label: str = "Churn",
    populations: Sequence[str] = DEFAULT_POPULATIONS,
    width: float = 6,
) -> DataFrame:
    """Histogram edges shared by all populations, one row per edge.

    Edges are the multiples of ``width`` from ``floor(min / width) * width``
    until one reaches the maximum; at least one bar; ``[0, width]`` when there is no
    observation. Columns: ``edge_index, edge``. The observed range is read at
    call time (one row); the edges are a partitioned range, however many.
    """
    w = _check_width(width)
    obs = _observations(df, measure, label, populations, "_status")
    ends = obs.agg(F.min("_m").alias("low"), F.max("_m").alias("high")).first()
    first, bars = _bars(ends["low"], ends["high"], w)
    return _numbers(df, bars + 1, "edge_index").select(
        "edge_index", ((F.col("edge_index") + F.lit(first)) * F.lit(w)).alias("edge")
    )


# D5 --------------------------------------------------------------------------


def histogram_by_label(
    df: DataFrame,
    measure: str = "tenure",
    label: str = "Churn",
    populations: Sequence[str] = DEFAULT_POPULATIONS,
    width: float = 6,
    status: str = "churn_status",
) -> DataFrame:
    """Counts (not shares) per population per shared bin; empty bins are 0.

    Bins are closed on the left, the last one on both sides. Columns:
    ``churn_status, bin_index, bin_low, bin_high, observation_count,
    population_count``.

    Plan: the edges are multiples of ``width``, so the bins are numbered without
    the range: one scan counts every population's observations per bin (partial
    per task) with the ends of each. The range, the population counts and the
    empty bins (a partitioned range) follow from these counts, which are
    written to the checkpoint folder.
    """
    w = _check_width(width)
    m = F.col("_m")
    binned = materialize(
        _observations(df, measure, label, populations, status)
        .groupBy(status, _bin_column(m, w).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(m).alias("_low"), F.max(m).alias("_high"))
    )
    per = {
        r[status]: r
        for r in binned.groupBy(status)
        .agg(F.sum("_n").alias("n"), F.min("_low").alias("low"), F.max("_high").alias("high"))
        .collect()
    }
    low = min((r["low"] for r in per.values()), default=None)
    first, bars = _bars(low, max((r["high"] for r in per.values()), default=None), w)
    placed = binned.select(status, F.least(F.col("_bin") - F.lit(first), F.lit(bars - 1)).cast("long").alias("bin_index"), "_n")
    spine = _numbers(df, bars, "bin_index").select(
        F.explode(F.array(*[F.lit(p) for p in populations])).alias(status), "bin_index", F.lit(0).alias("_n")
    )
    counts = placed.unionByName(spine).groupBy(status, "bin_index").agg(
        F.sum("_n").cast("bigint").alias("observation_count")
    )
    size = F.lit(0)
    for p, r in per.items():
        size = F.when(F.col(status) == p, F.lit(r["n"])).otherwise(size)
    return counts.select(
        status,
        "bin_index",
        ((F.col("bin_index") + F.lit(first)) * F.lit(w)).alias("bin_low"),
        ((F.col("bin_index") + F.lit(first + 1)) * F.lit(w)).alias("bin_high"),
        "observation_count",
        size.cast("bigint").alias("population_count"),
        ordinal_in(F.col(status), populations).alias("_ordinal"),
    ).orderBy("_ordinal", "bin_index").drop("_ordinal")


# D6 / D7 ---------------------------------------------------------------------


def _fence_values(q1: float, q3: float, whis: float) -> tuple[float, float]:
    reach = whis * (q3 - q1)
    return q1 - reach, q3 + reach


def _fence_ranges(brackets: Sequence[tuple[float, float]], whis: float) -> list[tuple[float, float]]:
    """Where the two fences must lie when the quartiles lie in their brackets.

    Rounded sums and products keep order, so the ends follow from the ends of
    the brackets by the fences' own formula; interpolation may leave a bracket
    by its rounding. Without finite ends a fence may lie anywhere.
    """
    (a, b), _, (c, d) = brackets
    slack = 4 * sys.float_info.epsilon * max(map(abs, (a, b, c, d)))
    a, b, c, d = a - slack, b + slack, c - slack, d + slack
    ends = [(_fence_values(a, d, whis)[0], _fence_values(b, c, whis)[0])]
    ends.append((_fence_values(b, c, whis)[1], _fence_values(a, d, whis)[1]))
    if whis < 0 or not all(math.isfinite(x) for pair in ends for x in pair):
        return [(-math.inf, math.inf)] * 2
    return ends


def _fences(obs: DataFrame, populations, status, whis, method, accuracy, counted=False) -> tuple[DataFrame, DataFrame | None]:
    """Per population (one row each): n, quartiles and the whisker fences; with ``counted`` also the observations' cells.

    One scan of the observations counts them and brackets (or approximates)
    the quartiles, a second one counts the values in the brackets; the fence
    rows are a small DataFrame with one row per population. ``counted`` adds
    cells (population, ``_low``, ``_high``, ``_n``) from the same second scan,
    none of which has a fence inside.
    """
    _check_method(method)
    m, whis = F.col("_m"), float(whis)
    got = [
        r.asDict()
        for r in obs.groupBy(F.col(status).alias("_g"))
        .agg(F.count(F.lit(1)).alias("size"), *_quartile_columns(m, method, accuracy))
        .collect()
    ]
    cells = None
    if counted and method == "exact":
        quart, cells = quantiles_and_cells(
            obs, status, "_m", QUARTILES, lambda brackets: _fence_ranges(brackets, whis), first=got
        )
        cells = cells.withColumnRenamed("_g", status)
    else:
        quart = _quartiles(obs, status, got, method)
        if counted:
            cells = obs.select(status, m.alias("_low"), m.alias("_high"), F.lit(1).alias("_n"))
    size = {r["_g"]: r["size"] for r in got}
    out = []
    for p in populations:
        q1, q2, q3 = quart.get(p, [None] * 3)
        fences = (None, None) if q1 is None else _fence_values(q1, q3, whis)
        out.append((p, size.get(p, 0), q1, q2, q3, None if q1 is None else q3 - q1, *fences))
    fences = obs.sparkSession.createDataFrame(
        out,
        f"`{status}` string, n bigint, q1 double, median double, q3 double, iqr double, _lo_fence double, _hi_fence double",
    ).coalesce(1)
    return fences, cells


def box_plot_stats(
    df: DataFrame,
    measure: str = "tenure",
    label: str = "Churn",
    populations: Sequence[str] = DEFAULT_POPULATIONS,
    whis: float = 1.5,
    method: str = "exact",
    accuracy: int = DEFAULT_ACCURACY,
    status: str = "churn_status",
) -> DataFrame:
    """Box-plot statistics per population.

    Whiskers end at the most extreme observation inside
    ``q1 - whis*iqr .. q3 + whis*iqr`` but never inside the box; fliers are
    the observations beyond the whiskers, which are exactly those beyond the
    fences. Columns: ``churn_status, n, q1, median, q3, iqr, lower_whisker,
    upper_whisker, flier_count``.

    Two scans (while the quartile brackets need no narrowing): the brackets
    also bound the fences, so the scan that counts the values in the brackets
    counts those near the fences too, and the rest by the side they lie on.
    """
    obs = _observations(df, measure, label, populations, status)
    fences, cells = _fences(obs, populations, status, whis, method, accuracy, counted=True)
    low, high, n = F.col("_low"), F.col("_high"), F.col("_n")
    inner = (
        cells.join(F.broadcast(fences.select(status, "_lo_fence", "_hi_fence")), status)
        .groupBy(status)
        .agg(
            F.min(F.when(low >= F.col("_lo_fence"), low)).alias("_lo_in"),
            F.max(F.when(high <= F.col("_hi_fence"), high)).alias("_hi_in"),
            F.sum(F.when((high < F.col("_lo_fence")) | (low > F.col("_hi_fence")), n)).alias("_fliers"),
        )
    )
    return (
        fences.join(F.broadcast(inner), status, "left")
        .select(
            status,
            "n",
            "q1",
            "median",
            "q3",
            "iqr",
            F.least(F.col("q1"), F.col("_lo_in")).alias("lower_whisker"),
            F.greatest(F.col("q3"), F.col("_hi_in")).alias("upper_whisker"),
            F.coalesce(F.col("_fliers"), F.lit(0)).cast("bigint").alias("flier_count"),
            ordinal_in(F.col(status), populations).alias("_ordinal"),
        )
        .orderBy("_ordinal")
        .drop("_ordinal")
    )


def box_plot_fliers(
    df: DataFrame,
    measure: str = "tenure",
    label: str = "Churn",
    populations: Sequence[str] = DEFAULT_POPULATIONS,
    whis: float = 1.5,
    method: str = "exact",
    accuracy: int = DEFAULT_ACCURACY,
    status: str = "churn_status",
) -> DataFrame:
    """The individual observations beyond the whiskers, one row each (D7); stays distributed."""
    obs = _observations(df, measure, label, populations, status)
    fences, _ = _fences(obs, populations, status, whis, method, accuracy)
    m = F.col("_m")
    return (
        obs.join(F.broadcast(fences.select(status, "_lo_fence", "_hi_fence")), status)
        .where((m < F.col("_lo_fence")) | (m > F.col("_hi_fence")))
        .select(status, m.alias(measure))
    )
