"""Exact interpolated quantiles per group by narrowing ranks.

Spark's exact ``percentile`` keeps one counter per distinct value of a group
inside one task, which is unbounded for a continuous measure. This helper
returns the same numbers (linear interpolation between the two order
statistics around ``p * (n - 1)``) from a few scans with bounded state:

1. a first aggregate gives each group's count, minimum and maximum, and
   ``percentile_approx`` a little below and above every probability. Two such
   values bracket the wanted ranks whatever the values are, infinities included
   (the fewer values there are, the farther the two probabilities lie apart);
2. while a bracket may hold more than ``ROWS_AT_ONCE`` rows, or all together
   more than ``BRACKETS_AT_ONCE`` times as many, one scan counts
   the rows below and inside every bracket and takes a grid of approximate
   percentiles inside it; the grid cell that holds the rank is the new bracket;
3. a last scan counts each distinct value inside the brackets, and the rows
   between them; the ranks are read off these counts.

Ranks shrink by a factor of thousands a scan, so 600,000 rows take two scans
and 10^12 take four. A repeated value, however often, is one counted value.
Groups must be a bounded set (populations, column names).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.operators.materialize import materialize

#: Rank error of the approximate percentiles (1 / ACCURACY), cells of a grid, and rows counted value by value.
ACCURACY = 10_000
GRID = 500
#: How far beside a probability its bracket may end: the nearest that spans at least three ranks is taken.
MARGINS = (2 / ACCURACY, 0.002, 0.02, 0.2)
ROWS_AT_ONCE = 20_000
#: The same for all brackets together, in multiples of the bound of one: a table of many columns is narrowed further.
BRACKETS_AT_ONCE = 50


def bracket_columns(value: Column, probs: Sequence[float], prefix: str = "") -> list[Column]:
    """The columns of step 1, to be put into any aggregate per group (NULL values are ignored)."""
    near = [min(max(p + side * margin, 0.0), 1.0) for p in probs for margin in MARGINS for side in (-1, 1)]
    return [
        F.count(value).alias(f"{prefix}n"),
        F.min(value).alias(f"{prefix}lo"),
        F.max(value).alias(f"{prefix}hi"),
        F.percentile_approx(value, F.array(*[F.lit(p) for p in near]), ACCURACY).alias(f"{prefix}near"),
    ]


class _Target:
    """The wanted ranks of one probability in one group, and the bracket of values that holds them."""

    def __init__(self, n: int, p: float, near: Sequence[float], widest: tuple[float, float]):
        """``near`` holds the values beside ``p``, two a margin."""
        self.position = p * (n - 1)
        self.ranks = (math.floor(self.position), math.ceil(self.position))
        self.n = n
        self.widest = widest
        self.widen()
        for margin, low, high in zip(MARGINS, near[::2], near[1::2]):
            if (margin - 1 / ACCURACY) * n >= 3:
                self.low = widest[0] if p <= margin else low
                self.high = widest[1] if p >= 1 - margin else high
                self.share = 2 * margin + 2.0 / n
                break

    def rows(self) -> float:
        """Rows that may lie strictly inside the bracket."""
        return 0 if self.low == self.high else self.share * self.n

    def holds(self, value: float | None) -> bool:
        return value is not None and self.low <= value <= self.high

    def widen(self) -> None:
        self.low, self.high = self.widest
        self.share = 1.0

    def narrow(self, below: int, inside: int, grid: Sequence[float]) -> None:
        """A new bracket from the exact counts and the grid inside the old one."""
        first, last = self.ranks[0] - below, self.ranks[1] - below
        if first < 0 or last >= inside:  # an approximate end was off
            return self.widen()
        slack = 2.0 / ACCURACY
        a = math.floor((first / inside - slack) * GRID) - 1
        b = math.ceil((last / inside + slack) * GRID) + 1
        if a > 0:
            self.low = grid[a]
        if b < GRID:
            self.high = grid[b]
        self.share *= (b - a) / GRID + 2 * slack


def exact_quantiles(
    data: DataFrame,
    group: str,
    value: str,
    probs: Sequence[float],
    first: Sequence[Mapping] | None = None,
    rows_at_once: int = ROWS_AT_ONCE,
) -> dict[object, list[float | None]]:
    """``{group value: [quantile per prob]}``; groups without a value are absent.

    ``data`` holds ``group`` and ``value`` (NULL rows are ignored). ``first``
    may pass the result of step 1 from the caller's own aggregate: mappings
    with ``_g`` (group) and the columns of ``bracket_columns``.
    """
    return quantiles_and_cells(data, group, value, probs, None, first, rows_at_once)[0]


def quantiles_and_cells(
    data: DataFrame,
    group: str,
    value: str,
    probs: Sequence[float],
    around: Callable[[Sequence[tuple[float, float]]], Sequence[tuple[float, float]]] | None,
    first: Sequence[Mapping] | None = None,
    rows_at_once: int = ROWS_AT_ONCE,
) -> tuple[dict[object, list[float | None]], DataFrame | None]:
    """``exact_quantiles`` and, from the same last scan, all values in cells.

    ``around`` maps a group's brackets, one a probability, to intervals: values
    inside them have a cell each, so no cell lies on both sides of a point in
    an interval. Cells (``_g, _low, _high, _n``: ends and number of values) are
    written to the checkpoint folder and stay distributed, however many.
    """
    rows = data.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if first is None:
        first = [r.asDict() for r in rows.groupBy("_g").agg(*bracket_columns(F.col("_v"), probs)).collect()]
    targets = {
        r["_g"]: [
            _Target(r["n"], p, r["near"][i * 2 * len(MARGINS) : (i + 1) * 2 * len(MARGINS)], (r["lo"], r["hi"]))
            for i, p in enumerate(probs)
        ]
        for r in first
        if r["n"]
    }
    group_type = rows.schema["_g"].dataType.simpleString()
    if not targets:
        none = rows.sparkSession.createDataFrame([], f"_g {group_type}, _low double, _high double, _n bigint")
        return {}, none if around else None

    def near(ts: Sequence[_Target]) -> Sequence[tuple[float, float]]:
        return around([(t.low, t.high) for t in ts])

    def bracketed() -> DataFrame:
        """Rows with their group's brackets: one small row per group, broadcast."""
        frame = rows.sparkSession.createDataFrame(
            [
                (g, [t.low for t in ts], [t.high for t in ts], *map(list, zip(*near(ts))))
                if around
                else (g, [t.low for t in ts], [t.high for t in ts], [], [])
                for g, ts in targets.items()
            ],
            f"_g {group_type}, _lo array<double>, _hi array<double>, _from array<double>, _to array<double>",
        )
        return rows.join(F.broadcast(frame.coalesce(1)), "_g")

    found: dict[tuple, float] = {}
    while True:
        while _too_many([t.rows() for ts in targets.values() for t in ts], rows_at_once):
            _narrow(bracketed(), targets, len(probs))
        cells = _cells(bracketed(), len(probs), len(near(next(iter(targets.values())))) if around else 0)
        if around:
            cells = materialize(cells)
        found = _values_at_ranks(cells, targets)
        missed = [t for g, ts in targets.items() for t in ts if not all(t.holds(found.get((g, k))) for k in t.ranks)]
        if not missed:
            break
        for t in missed:  # an approximate end was off after all
            t.widen()
    out: dict[object, list[float | None]] = {}
    for g, ts in targets.items():
        out[g] = []
        for t in ts:
            (k0, k1), pos = t.ranks, t.position
            a, b = found[g, k0], found[g, k1]
            out[g].append(a if k0 == k1 else (k1 - pos) * a + (pos - k0) * b)
    return out, cells.select("_g", "_low", "_high", "_n") if around else None


def _too_many(rows: Sequence[float], at_once: int) -> bool:
    return max(rows) > at_once or sum(rows) > BRACKETS_AT_ONCE * at_once


def _narrow(rows: DataFrame, targets: Mapping[object, list[_Target]], count: int) -> None:
    """One scan: exact counts below and inside every bracket and a grid of percentiles inside; then new brackets."""
    v = F.col("_v")
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    aggs = []
    for i in range(count):
        inside = (v >= F.col("_lo")[i]) & (v <= F.col("_hi")[i])
        aggs += [
            F.count_if(v < F.col("_lo")[i]).alias(f"below{i}"),
            F.count_if(inside).alias(f"inside{i}"),
            F.percentile_approx(F.when(inside, v), grid, ACCURACY).alias(f"grid{i}"),
        ]
    for r in rows.groupBy("_g").agg(*aggs).collect():
        for i, t in enumerate(targets[r["_g"]]):
            if t.low != t.high:
                t.narrow(r[f"below{i}"], r[f"inside{i}"], r[f"grid{i}"] or [])


def _cells(rows: DataFrame, count: int, intervals: int) -> DataFrame:
    """Values inside brackets and intervals counted one by one, the rest by the brackets and intervals they lie above."""
    v = F.col("_v")
    inside, above, near, beyond = F.lit(False), F.lit(0), F.lit(False), F.lit(0)
    for i in range(count):
        inside = inside | ((v >= F.col("_lo")[i]) & (v <= F.col("_hi")[i]))
        above = above + (v > F.col("_hi")[i]).cast("int")
    for i in range(intervals):
        near = near | ((v >= F.col("_from")[i]) & (v <= F.col("_to")[i]))
        beyond = beyond + (v > F.col("_to")[i]).cast("int")
    return rows.groupBy(
        "_g",
        above.alias("_above"),
        beyond.alias("_beyond"),
        inside.alias("_inside"),
        F.when(inside | near, v).alias("_value"),
    ).agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_low"), F.max(v).alias("_high"))


def _values_at_ranks(cells: DataFrame, targets: Mapping[object, list[_Target]]) -> dict[tuple, float]:
    """The value at every wanted rank: values inside brackets rank one by one, the rest by the gap they fill."""
    ranked = cells.groupBy("_g", "_above", F.when(F.col("_inside"), F.col("_value")).alias("_at"))
    per_group: dict[object, list[tuple]] = {}
    for r in ranked.agg(F.sum("_n").alias("_n")).collect():
        per_group.setdefault(r["_g"], []).append((r["_above"], r["_at"], r["_n"]))
    # Rows outside all brackets sort by how many brackets they lie above, before the values of the next one.
    found: dict[tuple, float] = {}
    for g, told in per_group.items():
        wanted = sorted({k for t in targets[g] for k in t.ranks})
        highs = sorted(t.high for t in targets[g])
        lows = {a: min((t.low for t in targets[g] if t.high >= highs[a]), default=math.inf) for a in range(len(highs))}
        gap = [(lows.get(a, math.inf), 0, n) for a, at, n in told if at is None]
        ranked = sorted([(at, 1, n) for _, at, n in told if at is not None] + gap)
        below = 0
        for at, kind, n in ranked:
            while wanted and wanted[0] < below + n:
                k = wanted.pop(0)
                if kind:
                    found[g, k] = at
            below += n
    return found
