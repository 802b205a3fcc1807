"""Registered queries: one per operator binding, each with its DuckDB oracle.

Every query reads the driver tables (or the views of ``bindings`` over them)
in full. Floating statistics whose last bit depends on summation order or on
the interpolation formula are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.operators import dist, quality, segments
from segstats.operators.materialize import materialize
from segstats.operators.quality import Implication, QualityConfig
from segstats.plans import bindings as B
from segstats.session import shared_dir
from segstats.sources.records import preview, read_records
from segstats.sources.tables import load_table

Query = Callable[[SparkSession, str], DataFrame]

# --- Fixed parameters of the registered queries --------------------------------
CUST_SEGMENTS = ("BUILDING", "MACHINERY", "RETAIL")
CUST_BASELINE = 46.0
LI_SEGMENTS = ("O", "F")
LI_BASELINE = 33.3
SLICE_BOUNDS = (0, 60)
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
LI_RULES = (
    Implication("final_lines_returned", "l_linestatus", "F", ("l_returnflag",), "R"),
    Implication("unreturned_lines_open", "l_returnflag", "N", ("l_linestatus",), "O"),
    Implication("final_lines_alike", "l_linestatus", "F", ("l_returnflag", "l_linestatus"), "F"),
)
LI_REPEATED = ["l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
ORDER_DOMAINS = {
    "o_orderstatus": ("F", "O"),
    "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
}
CUSTOMER_QUALITY = QualityConfig(
    id_column="c_custkey",
    exclude_categorical=("c_name",),
    minimums={"c_acctbal": 0.0},
    domains={"c_mktsegment": ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")},
    range_columns=("c_acctbal",),
)
CHARGES_RULE = Implication("building_accounts", "c_mktsegment", "BUILDING", ("TotalCharges", "c_mktsegment"), "BUILDING")
CHARGES_CONTEXT = ("customerID", "c_nationkey", "TotalCharges")
CHARGES_QUALITY = QualityConfig(
    id_column="c_nationkey",
    exclude_categorical=("TotalCharges",),
    rules=(CHARGES_RULE,),
    numeric_text_column="TotalCharges",
    minimums={"c_nationkey": 3},
    domains={"c_nationkey": (0, 1, 2)},
    blank_context_column="c_nationkey",
    contexts={"TotalCharges": CHARGES_CONTEXT, "c_nationkey": CHARGES_CONTEXT},
)
# -------------------------------------------------------------------------------


def _round(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


D1_STATS = ["mean_tenure", "median_tenure", "q1_tenure", "q3_tenure", "iqr_tenure", "min_tenure", "max_tenure"]
BOX_STATS = ["q1", "median", "q3", "iqr", "lower_whisker", "upper_whisker"]


def _csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "csv-roundtrip")
    load_table(spark, d, "customer").write.option("header", "true").csv(path)
    return read_records(spark, path)


def _slice_reconciles(cust: DataFrame) -> DataFrame:
    """Both sides from one copy of the joined view: its two small columns are written once."""
    view = materialize(cust.select("tenure", "Churn"))
    return segments.reconcile_slice(segments.rate_by_value(view), segments.slice_vs_baseline(view, *SLICE_BOUNDS))


QUERIES: dict[str, Query] = {
    # R10
    "rate_by_value_cust": lambda s, d: segments.rate_by_value(B.cust(s, d)),
    "rate_by_value_li": lambda s, d: segments.rate_by_value(
        B.li(s, d), measure="l_quantity", label="returned", value_name="quantity"
    ),
    # R7 - R9
    "slice_vs_baseline": lambda s, d: segments.slice_vs_baseline(B.cust(s, d), *SLICE_BOUNDS),
    # R13
    "slice_reconciles": lambda s, d: _slice_reconciles(B.cust(s, d)),
    # R2, R3
    "retention_baseline": lambda s, d: segments.retention_baseline(B.cust_unknown(s, d)),
    "status_table": lambda s, d: segments.status_table(B.cust_unknown(s, d)),
    # R4 - R6
    "segment_rates_cust": lambda s, d: segments.segment_rates(
        B.cust(s, d), CUST_BASELINE, expected=CUST_SEGMENTS
    ),
    "segment_rates_li": lambda s, d: segments.segment_rates(
        B.li(s, d), LI_BASELINE, segment="l_linestatus", expected=LI_SEGMENTS, label="returned", value_name="linestatus"
    ),
    # D1
    "distribution_by_label_cust": lambda s, d: _round(dist.distribution_by_label(B.cust(s, d)), D1_STATS),
    "distribution_by_label_li": lambda s, d: _round(
        dist.distribution_by_label(B.li(s, d), measure="l_quantity", label="returned"), D1_STATS
    ),
    # D2 - D5
    "population_observations": lambda s, d: dist.population_observations(B.cust(s, d)),
    "observed_range": lambda s, d: dist.observed_range(B.cust(s, d)),
    "shared_bin_edges": lambda s, d: dist.shared_bin_edges(B.cust(s, d)),
    "histogram_by_label": lambda s, d: dist.histogram_by_label(B.cust(s, d)),
    "histogram_by_label_li": lambda s, d: dist.histogram_by_label(
        B.li(s, d), measure="l_quantity", label="returned", width=5
    ),
    # D6, D7
    "box_plot_stats_cust": lambda s, d: _round(dist.box_plot_stats(B.cust(s, d)), BOX_STATS),
    "box_plot_stats_events": lambda s, d: _round(
        dist.box_plot_stats(load_table(s, d, "events"), measure="value", label="event_type", populations=EVENT_TYPES),
        BOX_STATS,
    ),
    "box_plot_fliers_events": lambda s, d: dist.box_plot_fliers(
        load_table(s, d, "events"), measure="value", label="event_type", populations=EVENT_TYPES
    ),
    # Q1, Q2
    "duplicate_rows": lambda s, d: quality.count_duplicate_rows(
        load_table(s, d, "documents"), ["text", "lang", "source", "n_chars"]
    ),
    "duplicate_rows_lineitem": lambda s, d: quality.count_duplicate_rows(load_table(s, d, "lineitem"), LI_REPEATED),
    "duplicate_ids": lambda s, d: quality.count_duplicate_ids(load_table(s, d, "lineitem"), "l_orderkey"),
    "duplicate_texts": lambda s, d: quality.count_duplicate_ids(load_table(s, d, "documents"), "text"),
    # Q3, S3, S4, S5
    "missing_by_column": lambda s, d: _round(quality.missing_by_column(B.cust(s, d)), ["missing_percent"]),
    "table_shape": lambda s, d: quality.table_shape(B.cust(s, d)),
    "schema_profile": lambda s, d: quality.schema_profile(B.cust(s, d)),
    # The view joins two tables and describe reads it in several passes: checkpoint it once.
    "describe_columns": lambda s, d: _round(
        quality.describe_columns(materialize(B.cust(s, d))), ["mean", "std", "min", "p25", "p50", "p75", "max"]
    ),
    # Q4, Q5
    "categorical_profile_orders": lambda s, d: _round(
        quality.categorical_profile(load_table(s, d, "orders"), exclude=("o_orderdate",)), ["value_percent"]
    ),
    "categorical_profile_lineitem": lambda s, d: _round(
        quality.categorical_profile(load_table(s, d, "lineitem"), exclude=("l_shipdate",)), ["value_percent"]
    ),
    # Q6 - Q8
    "implication_violations": lambda s, d: quality.implication_violations(load_table(s, d, "lineitem"), LI_RULES),
    "implication_support": lambda s, d: quality.implication_support(load_table(s, d, "lineitem"), LI_RULES),
    # Q9 - Q12
    "numeric_readability": lambda s, d: quality.numeric_readability(B.charges(s, d), "TotalCharges"),
    "class_context": lambda s, d: quality.class_context(B.charges(s, d), "TotalCharges", "c_nationkey"),
    "affected_sample": lambda s, d: quality.readability_sample(
        B.charges(s, d), "TotalCharges", ["customerID", "c_nationkey", "c_acctbal", "TotalCharges"], ["customerID"]
    ),
    # Q13 - Q15
    "below_minimum": lambda s, d: quality.below_minimum(load_table(s, d, "customer"), "c_acctbal", 0),
    "below_minimum_values": lambda s, d: quality.below_minimum_values(load_table(s, d, "customer"), "c_acctbal", 0),
    "outside_domain": lambda s, d: quality.outside_domain(load_table(s, d, "lineitem"), "l_linenumber", (0, 1)),
    "outside_domain_count": lambda s, d: quality.outside_domain_count(
        load_table(s, d, "lineitem"), "l_linenumber", (0, 1)
    ),
    "range_profile": lambda s, d: quality.range_profile(load_table(s, d, "part"), "p_retailprice"),
    # Q16
    "domain_conformance": lambda s, d: quality.domain_conformance(load_table(s, d, "orders"), ORDER_DOMAINS),
    # Q17
    "product_residual": lambda s, d: _round(
        quality.product_residual(
            load_table(s, d, "lineitem").join(
                load_table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")
            ),
            "l_extendedprice",
            "l_quantity",
            "p_retailprice",
        ),
        ["mean_abs_difference", "min_difference", "max_difference"],
    ),
    # NaN is missing: Q1, Q2, Q10, Q11, Q17 over a table that holds some
    "duplicate_rows_nan": lambda s, d: quality.count_duplicate_rows(B.prices(s, d), ["price", "size"]),
    "duplicate_ids_nan": lambda s, d: quality.count_duplicate_ids(B.prices(s, d), "price"),
    "numeric_readability_nan": lambda s, d: quality.numeric_readability(B.prices(s, d), "price"),
    "class_context_nan": lambda s, d: quality.class_context(B.prices(s, d), "note", "price"),
    "product_residual_nan": lambda s, d: _round(
        quality.product_residual(B.prices(s, d), "total", "price", "size"),
        ["mean_abs_difference", "min_difference", "max_difference"],
    ),
    # Q18
    "quality_report_charges": lambda s, d: _round(quality.quality_report(B.charges(s, d), CHARGES_QUALITY), ["metric"]),
    "quality_report": lambda s, d: _round(quality.quality_report(load_table(s, d, "customer"), CUSTOMER_QUALITY), ["metric"]),
    # S1, S2
    "csv_roundtrip": _csv_roundtrip,
    "preview": lambda s, d: preview(load_table(s, d, "customer"), 5, ["c_custkey"]),
}


# --- Oracle SQL (DuckDB) ---------------------------------------------------------


def _with(*views: str) -> str:
    return "WITH " + ",".join(views) + "\n"


_R10_CUST = """
SELECT tenure AS tenure_month, count(*) AS customer_count,
       count(*) FILTER (WHERE Churn = 'Yes') AS churned_count,
       count(*) FILTER (WHERE Churn = 'No') AS retained_count,
       (count(*) FILTER (WHERE Churn = 'Yes')) / count(*) AS churn_rate
FROM cust WHERE tenure IS NOT NULL GROUP BY tenure"""

_R7 = f"""
t AS (SELECT count(*) FILTER (WHERE tenure BETWEEN {SLICE_BOUNDS[0]} AND {SLICE_BOUNDS[1]}) AS sn,
             count(*) FILTER (WHERE tenure BETWEEN {SLICE_BOUNDS[0]} AND {SLICE_BOUNDS[1]} AND Churn = 'Yes') AS sc,
             count(*) FILTER (WHERE tenure BETWEEN {SLICE_BOUNDS[0]} AND {SLICE_BOUNDS[1]} AND Churn = 'No') AS sr,
             count(*) AS n, count(*) FILTER (WHERE Churn = 'Yes') AS c
      FROM cust),
r AS (SELECT *, sc / nullif(sn, 0) AS srate, c / nullif(n, 0) AS orate FROM t)"""

_R7_SELECT = f"""
SELECT {SLICE_BOUNDS[0]} AS slice_min_tenure, {SLICE_BOUNDS[1]} AS slice_max_tenure,
       sn AS slice_customer_count, sc AS slice_churned_count, sr AS slice_retained_count,
       srate AS slice_churn_rate, sn / nullif(n, 0) AS slice_population_share,
       sc / nullif(c, 0) AS slice_churn_contribution, n AS overall_customer_count,
       c AS overall_churned_count, orate AS overall_churn_rate, srate - orate AS rate_difference,
       srate / nullif(orate, 0) AS relative_churn_rate
FROM r"""


def _r4(view: str, seg: str, expected, label: str, baseline: float, out: str) -> str:
    dom = " UNION ALL ".join(f"SELECT '{v}' AS s, 0 AS w, 0 AS ch" for v in expected)
    lst = ", ".join(f"'{v}'" for v in expected)
    return f"""
WITH x AS (SELECT {seg} AS s, 1 AS w, CASE WHEN {label} = 'Yes' THEN 1 ELSE 0 END AS ch FROM {view}
           UNION ALL {dom}),
g AS (SELECT s, CAST(sum(w) AS BIGINT) AS n, CAST(sum(ch) AS BIGINT) AS c FROM x GROUP BY s)
SELECT s AS {out},
       CASE WHEN s IS NULL THEN 'missing' WHEN s IN ({lst}) THEN 'expected' ELSE 'unexpected' END AS value_status,
       n AS customer_count, c AS churned_count, c / nullif(n, 0) * 100.0 AS churn_rate_percent,
       c / nullif(n, 0) * 100.0 - {baseline} AS difference_percentage_points
FROM g"""


def _d1(view: str, measure: str, label: str) -> str:
    return f"""
WITH x AS (SELECT {label} AS churn_status, CAST({measure} AS DOUBLE) AS m, 1 AS w FROM {view} WHERE {label} IN ('No', 'Yes')
           UNION ALL SELECT 'No', NULL, 0 UNION ALL SELECT 'Yes', NULL, 0),
g AS (SELECT churn_status, CAST(sum(w) AS BIGINT) AS n, count(m) AS v, avg(m) AS mean,
             quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS med, quantile_cont(m, 0.75) AS q3,
             min(m) AS mn, max(m) AS mx
      FROM x GROUP BY churn_status)
SELECT churn_status, n AS customer_count, n - v AS missing_tenure_count, v AS valid_tenure_count,
       round(mean, 6) AS mean_tenure, round(med, 6) AS median_tenure, round(q1, 6) AS q1_tenure,
       round(q3, 6) AS q3_tenure, round(q3 - q1, 6) AS iqr_tenure, round(mn, 6) AS min_tenure,
       round(mx, 6) AS max_tenure
FROM g"""


def _obs(view: str, measure: str, label: str, pops) -> str:
    lst = ", ".join(f"'{p}'" for p in pops)
    return f"""obs AS (SELECT {label} AS churn_status, CAST({measure} AS DOUBLE) AS m FROM {view}
         WHERE {label} IN ({lst}) AND {measure} IS NOT NULL AND NOT isnan(CAST({measure} AS DOUBLE)))"""


def _bounds_sql(width: float) -> str:
    return f"""bounds AS (
  SELECT lo, CAST(greatest(coalesce(ceil((mx - lo) / {float(width)}), 1), 1) AS INTEGER) AS nb
  FROM (SELECT CAST(coalesce(floor(min(m) / {float(width)}) * {float(width)}, 0.0) AS DOUBLE) AS lo, max(m) AS mx FROM obs))"""


def _d5(view: str, measure: str, label: str, width: float) -> str:
    w = float(width)
    return (
        "WITH "
        + _obs(view, measure, label, ("No", "Yes"))
        + ",\n"
        + _bounds_sql(width)
        + f""",
binned AS (SELECT churn_status, CAST(least(floor((m - (SELECT lo FROM bounds)) / {w}), (SELECT nb FROM bounds) - 1) AS BIGINT) AS b, 1 AS w FROM obs),
spine AS (SELECT p.churn_status, CAST(r.b AS BIGINT) AS b, 0 AS w
          FROM (SELECT unnest(['No', 'Yes']) AS churn_status) p,
               (SELECT unnest(range(0, (SELECT nb FROM bounds))) AS b) r),
g AS (SELECT churn_status, b, CAST(sum(w) AS BIGINT) AS n FROM (SELECT * FROM binned UNION ALL SELECT * FROM spine) GROUP BY churn_status, b)
SELECT churn_status, b AS bin_index, (SELECT lo FROM bounds) + b * {w} AS bin_low,
       (SELECT lo FROM bounds) + (b + 1) * {w} AS bin_high, n AS observation_count,
       CAST(sum(n) OVER (PARTITION BY churn_status) AS BIGINT) AS population_count
FROM g"""
    )


def _box(view: str, measure: str, label: str, pops, whis: float = 1.5) -> str:
    zero = " UNION ALL ".join(f"SELECT '{p}', NULL, 0" for p in pops)
    return (
        "WITH "
        + _obs(view, measure, label, pops)
        + f""",
q AS (SELECT churn_status, CAST(sum(w) AS BIGINT) AS n, quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS med,
             quantile_cont(m, 0.75) AS q3
      FROM (SELECT churn_status, m, 1 AS w FROM obs UNION ALL {zero}) GROUP BY churn_status),
f AS (SELECT *, q3 - q1 AS iqr, q1 - {whis} * (q3 - q1) AS lf, q3 + {whis} * (q3 - q1) AS hf FROM q),
i AS (SELECT o.churn_status, min(CASE WHEN o.m >= f.lf THEN o.m END) AS lo_in,
             max(CASE WHEN o.m <= f.hf THEN o.m END) AS hi_in,
             count(*) FILTER (WHERE o.m < f.lf OR o.m > f.hf) AS fl
      FROM obs o JOIN f ON o.churn_status = f.churn_status GROUP BY o.churn_status)"""
    )


def _box_stats(view, measure, label, pops) -> str:
    return (
        _box(view, measure, label, pops)
        + """
SELECT f.churn_status, f.n, round(f.q1, 6) AS q1, round(f.med, 6) AS median, round(f.q3, 6) AS q3,
       round(f.iqr, 6) AS iqr, round(least(f.q1, coalesce(i.lo_in, f.q1)), 6) AS lower_whisker,
       round(greatest(f.q3, coalesce(i.hi_in, f.q3)), 6) AS upper_whisker,
       CAST(coalesce(i.fl, 0) AS BIGINT) AS flier_count
FROM f LEFT JOIN i ON f.churn_status = i.churn_status"""
    )


def _union_rows(rows) -> str:
    return "\nUNION ALL ".join(rows)


_CUST_COLS = [("customerID", "bigint"), ("tenure", "bigint"), ("Churn", "string"), ("Contract", "string"), ("nation", "int")]


def _missing_sql() -> str:
    rows = [
        f"SELECT '{c}' AS column_name, {i} AS position, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
        f"round(count(*) FILTER (WHERE {c} IS NULL) / nullif(count(*), 0) * 100.0, 6) AS missing_percent FROM cust"
        for i, (c, _) in enumerate(_CUST_COLS)
    ]
    return _with(B.CUST_SQL) + _union_rows(rows)


def _schema_sql() -> str:
    rows = [
        f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS data_type, count({c}) AS non_null_count FROM cust"
        for i, (c, t) in enumerate(_CUST_COLS)
    ]
    return _with(B.CUST_SQL) + _union_rows(rows)


def _describe_sql() -> str:
    rows = []
    for i, (c, t) in enumerate(_CUST_COLS):
        if t != "string":
            x = f"CAST({c} AS DOUBLE)"
            rows.append(
                f"SELECT '{c}' AS column_name, {i} AS position, 'numeric' AS kind, count({x}) AS count, "
                f"CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, "
                f"round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
                f"round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, "
                f"round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM cust"
            )
        else:
            rows.append(
                f"SELECT '{c}', {i}, 'text', (SELECT count({c}) FROM cust), (SELECT count(DISTINCT {c}) FROM cust), "
                f"(SELECT {c} FROM cust WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), "
                f"(SELECT count(*) FROM cust WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), "
                "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
                "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
            )
    return _with(B.CUST_SQL) + _union_rows(rows)


def _profile_sql(table: str, cols) -> str:
    rows = [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {table}" for c in cols]
    return (
        "WITH long AS (" + _union_rows(rows) + ")\n"
        f"SELECT column_name, value, count(*) AS value_count, "
        f"round(count(*) / (SELECT count(*) FROM {table}) * 100.0, 6) AS value_percent "
        "FROM long GROUP BY column_name, value"
    )


def _violations_sql(rules) -> str:
    rows = []
    for r in rules:
        for dep in r.dependents:
            rows.append(
                f"SELECT '{r.name}' AS rule, '{dep}' AS column_name, '{r.expected}' AS expected_value, "
                f"CAST({dep} AS VARCHAR) AS observed_value FROM lineitem "
                f"WHERE {r.trigger} = '{r.trigger_value}' AND {dep} IS DISTINCT FROM '{r.expected}'"
            )
    return (
        "SELECT rule, column_name, expected_value, observed_value, count(*) AS affected_rows FROM ("
        + _union_rows(rows)
        + ") GROUP BY ALL"
    )


def _support_sql(rules) -> str:
    rows = []
    for r in rules:
        bad = " OR ".join(f"{d} IS DISTINCT FROM '{r.expected}'" for d in r.dependents)
        rows.append(
            f"SELECT '{r.name}' AS rule, '{r.trigger}' AS trigger_column, '{r.trigger_value}' AS trigger_value, "
            f"count(*) FILTER (WHERE {r.trigger} = '{r.trigger_value}') AS trigger_rows, "
            f"count(*) FILTER (WHERE {r.trigger} = '{r.trigger_value}' AND ({bad})) AS violating_rows, "
            f"count(*) FILTER (WHERE {r.trigger} = '{r.trigger_value}' AND ({bad})) = 0 AS holds FROM lineitem"
        )
    return _union_rows(rows)


# DuckDB spelling of the readability classes (same whitelist as the Spark side).
_BLANK_RE = r"[\x{09}\x{0A}\x{0B}\x{0C}\x{0D}\x{1C}\x{1D}\x{1E}\x{1F}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
_NUM_RE = r"(?i)(\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*|[+-]?inf(inity)?)"


def _class_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN 'missing' "
        f"WHEN regexp_full_match({c}, '{_BLANK_RE}') THEN 'blank' "
        f"WHEN regexp_full_match({c}, '{_NUM_RE}') AND TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 'convertible' "
        "ELSE 'non_numeric' END"
    )


def _readability_sql() -> str:
    rows = [
        f"SELECT 'TotalCharges' AS column_name, 'string' AS stored_type, '{k}' AS value_class, "
        f"count(*) FILTER (WHERE cls = '{k}') AS row_count FROM x"
        for k in quality.READABILITY_CLASSES
    ]
    return (
        _with(B.CHARGES_SQL, f"x AS (SELECT {_class_sql('TotalCharges')} AS cls FROM charges)")
        + _union_rows(rows)
    )


def _residual_sql() -> str:
    return """
WITH x AS (SELECT l_extendedprice - l_quantity * p_retailprice AS d
           FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice))
SELECT count(*) FILTER (WHERE d IS NOT NULL) AS convertible_count,
       count(*) FILTER (WHERE abs(d) < 0.005) AS zero_difference_count,
       count(*) FILTER (WHERE abs(d) >= 0.005) AS nonzero_difference_count,
       round(avg(abs(d)), 6) AS mean_abs_difference, round(min(d), 6) AS min_difference,
       round(max(d), 6) AS max_difference
FROM x WHERE d IS NOT NULL"""


def _report_sql() -> str:
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

    def r(step, section, item, column, value, count, metric):
        return (
            f"SELECT {step} AS step, '{section}' AS section, {item} AS item, {column} AS column_name, "
            f"CAST({value} AS VARCHAR) AS value, CAST({count} AS BIGINT) AS row_count, CAST({metric} AS DOUBLE) AS metric"
        )

    rows = [
        r(0, "shape", "'rows'", "NULL", "NULL", "(SELECT count(*) FROM customer)", "NULL"),
        r(0, "shape", "'columns'", "NULL", "NULL", len(cols), "NULL"),
        r(1, "duplicates", "'duplicate_rows'", "NULL", "NULL",
          "(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment))", "NULL"),
        r(1, "duplicates", "'duplicate_ids'", "'c_custkey'", "NULL",
          "(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey))", "NULL"),
    ]
    rows += [
        r(2, "missing", "'missing_values'", f"'{c}'", "NULL", f"(SELECT count(*) FILTER (WHERE {c} IS NULL) FROM customer)",
          f"round((SELECT count(*) FILTER (WHERE {c} IS NULL) / nullif(count(*), 0) * 100.0 FROM customer), 6)")
        for c in cols
    ]
    rows.append(
        "SELECT 3, 'categorical_profile', 'value_count', 'c_mktsegment', c_mktsegment, count(*), "
        "round(count(*) / (SELECT count(*) FROM customer) * 100.0, 6) FROM customer GROUP BY c_mktsegment"
    )
    rows += [
        r(6, "below_minimum", "'observed_min'", "'c_acctbal'", "NULL", "NULL", "round((SELECT min(c_acctbal) FROM customer), 6)"),
        r(6, "below_minimum", "'below_count'", "'c_acctbal'", "NULL", "(SELECT count(*) FILTER (WHERE c_acctbal < 0) FROM customer)", "0.0"),
        r(7, "outside_domain", "'outside_count'", "'c_mktsegment'", "NULL",
          "(SELECT count(*) FILTER (WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')) FROM customer)", "NULL"),
        r(8, "range", "'missing_count'", "'c_acctbal'", "NULL", "(SELECT count(*) FILTER (WHERE c_acctbal IS NULL) FROM customer)", "NULL"),
        r(8, "range", "'observed_min'", "'c_acctbal'", "NULL", "NULL", "round((SELECT min(c_acctbal) FROM customer), 6)"),
        r(8, "range", "'observed_max'", "'c_acctbal'", "NULL", "NULL", "round((SELECT max(c_acctbal) FROM customer), 6)"),
    ]
    rows.append(
        "SELECT 6, 'below_minimum', 'value_count', 'c_acctbal', CAST(c_acctbal AS VARCHAR), count(*), NULL FROM customer "
        "WHERE c_acctbal < 0 GROUP BY c_acctbal"
    )
    rows.append(
        "SELECT 7, 'outside_domain', 'value_count', 'c_mktsegment', c_mktsegment, count(*), NULL FROM customer "
        "WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING','FURNITURE','HOUSEHOLD','MACHINERY') GROUP BY c_mktsegment"
    )
    return _union_rows(rows)


_READ = (
    "CASE WHEN TotalCharges IS NULL THEN 'missing' WHEN trim(TotalCharges) = '' THEN 'blank' "
    "WHEN try_cast(TotalCharges AS DOUBLE) IS NULL THEN 'non_numeric' ELSE 'convertible' END"
)


def _charges_report_sql() -> str:
    """The report's sections over the charges view, a SELECT each."""
    cols = ["customerID", "c_nationkey", "c_acctbal", "c_mktsegment", "TotalCharges"]

    def one(step, section, item, column, value, count, metric, tail="FROM charges"):
        return (
            f"SELECT {step} AS step, '{section}' AS section, {item} AS item, {column} AS column_name, "
            f"CAST({value} AS VARCHAR) AS value, CAST({count} AS BIGINT) AS row_count, CAST({metric} AS DOUBLE) AS metric {tail}"
        )

    def repeats(columns):
        return f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM charges GROUP BY {columns}))"

    def affected(step, section, column, wrong):
        fields = ", ".join(f"'{c}': {c}" for c in CHARGES_CONTEXT)
        return (
            f"(SELECT {step}, '{section}', 'affected_record', '{column}', CAST(to_json({{{fields}}}) AS VARCHAR), "
            f"(SELECT count(*) FROM charges WHERE {wrong}), NULL FROM charges WHERE {wrong} ORDER BY customerID LIMIT 10)"
        )

    fired = "c_mktsegment = 'BUILDING'"
    departs = "TotalCharges IS DISTINCT FROM 'BUILDING'"
    rows = [
        one(0, "shape", "'rows'", "NULL", "NULL", "count(*)", "NULL"),
        one(0, "shape", "'columns'", "NULL", "NULL", len(cols), "NULL", ""),
        one(1, "duplicates", "'duplicate_rows'", "NULL", "NULL", repeats(", ".join(cols)), "NULL", ""),
        one(1, "duplicates", "'duplicate_ids'", "'c_nationkey'", "NULL", repeats("c_nationkey"), "NULL", ""),
    ]
    rows += [
        one(2, "missing", "'missing_values'", f"'{c}'", "NULL", f"count(*) - count({c})",
            f"round((count(*) - count({c})) / nullif(count(*), 0) * 100.0, 6)")
        for c in cols
    ]
    rows += [
        one(3, "categorical_profile", "'value_count'", "'c_mktsegment'", "c_mktsegment", "count(*)",
            "round(count(*) / (SELECT count(*) FROM charges) * 100.0, 6)", "FROM charges GROUP BY c_mktsegment"),
        one(4, "implication", "'building_accounts'", "'c_mktsegment'", "'BUILDING'", f"count(*) FILTER (WHERE {fired})",
            f"count(*) FILTER (WHERE {fired} AND {departs})"),
        one(4, "implication_violation", "'building_accounts'", "'TotalCharges'", "TotalCharges", "count(*)", "NULL",
            f"FROM charges WHERE {fired} AND {departs} GROUP BY TotalCharges"),
    ]
    rows += [
        one(5, "readability", f"'{k}'", "'TotalCharges'", "NULL", f"count(*) FILTER (WHERE {_READ} = '{k}')", "NULL")
        for k in ("missing", "blank", "non_numeric", "convertible")
    ]
    rows += [
        one(5, "blank_context", "'c_nationkey'", "'TotalCharges'", "c_nationkey", "count(*)", "NULL",
            f"FROM charges WHERE {_READ} = 'blank' AND c_nationkey IS NOT NULL GROUP BY c_nationkey"),
        one(6, "below_minimum", "'observed_min'", "'c_nationkey'", "NULL", "NULL", "min(c_nationkey)"),
        one(6, "below_minimum", "'below_count'", "'c_nationkey'", "NULL", "count(*) FILTER (WHERE c_nationkey < 3)", "3.0"),
        one(6, "below_minimum", "'value_count'", "'c_nationkey'", "c_nationkey", "count(*)", "NULL",
            "FROM charges WHERE c_nationkey < 3 GROUP BY c_nationkey"),
        one(7, "outside_domain", "'outside_count'", "'c_nationkey'", "NULL",
            "count(*) FILTER (WHERE c_nationkey IS NULL OR c_nationkey NOT IN (0, 1, 2))", "NULL"),
        one(7, "outside_domain", "'value_count'", "'c_nationkey'", "c_nationkey", "count(*)", "NULL",
            "FROM charges WHERE c_nationkey IS NULL OR c_nationkey NOT IN (0, 1, 2) GROUP BY c_nationkey"),
        affected(5, "readability", "TotalCharges", f"{_READ} <> 'convertible'"),
        affected(6, "below_minimum", "c_nationkey", "c_nationkey < 3"),
        affected(7, "outside_domain", "c_nationkey", "c_nationkey IS NULL OR c_nationkey NOT IN (0, 1, 2)"),
    ]
    return _with(B.CHARGES_SQL) + _union_rows(rows)


def _prices(select: str) -> str:
    """Over the prices view, with NaN read as missing."""
    return _with(B.PRICES_SQL, "p AS (SELECT *, CASE WHEN isnan(price) THEN NULL ELSE price END AS x FROM prices)") + select


_NAN_SQL = {
    "duplicate_rows_nan": _prices(
        "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM p GROUP BY x, size)"
    ),
    "duplicate_ids_nan": _prices(
        "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_ids FROM (SELECT count(*) AS n FROM p GROUP BY x)"
    ),
    "numeric_readability_nan": _prices(
        "SELECT 'price' AS column_name, 'double' AS stored_type, k AS value_class, "
        "CASE k WHEN 'missing' THEN (SELECT count(*) FROM p WHERE x IS NULL) "
        "WHEN 'convertible' THEN (SELECT count(x) FROM p) ELSE 0 END AS row_count "
        "FROM (SELECT unnest(['missing', 'blank', 'non_numeric', 'convertible']) AS k)"
    ),
    "class_context_nan": _prices(
        "SELECT x AS price, count(*) AS row_count FROM p WHERE note = ' ' AND x IS NOT NULL GROUP BY x"
    ),
    "product_residual_nan": _prices(
        "SELECT count(d) AS convertible_count, count(*) FILTER (WHERE abs(d) < 0.005) AS zero_difference_count, "
        "count(*) FILTER (WHERE abs(d) >= 0.005) AS nonzero_difference_count, round(avg(abs(d)), 6) AS mean_abs_difference, "
        "round(min(d), 6) AS min_difference, round(max(d), 6) AS max_difference "
        "FROM (SELECT try_cast(total AS DOUBLE) - x * CAST(size AS DOUBLE) AS d FROM p) WHERE d IS NOT NULL"
    ),
}

ORACLE_SQL: dict[str, str] = {
    "rate_by_value_cust": _with(B.CUST_SQL) + _R10_CUST,
    "rate_by_value_li": _with(B.LI_SQL)
    + """
SELECT l_quantity AS quantity, count(*) AS customer_count,
       count(*) FILTER (WHERE returned = 'Yes') AS churned_count,
       count(*) FILTER (WHERE returned = 'No') AS retained_count,
       (count(*) FILTER (WHERE returned = 'Yes')) / count(*) AS churn_rate
FROM li WHERE l_quantity IS NOT NULL AND NOT isnan(l_quantity) GROUP BY l_quantity""",
    "slice_vs_baseline": _with(B.CUST_SQL, _R7) + _R7_SELECT,
    "slice_reconciles": _with(B.CUST_SQL, _R7, f"m AS ({_R10_CUST})")
    + f"""
SELECT CAST(coalesce(sum(m.customer_count), 0) AS BIGINT) AS value_customer_count,
       CAST(coalesce(sum(m.churned_count), 0) AS BIGINT) AS value_churned_count,
       CAST(coalesce(sum(m.retained_count), 0) AS BIGINT) AS value_retained_count,
       any_value(r.sn) AS slice_customer_count, any_value(r.sc) AS slice_churned_count,
       any_value(r.sr) AS slice_retained_count,
       coalesce(sum(m.customer_count), 0) = any_value(r.sn) AND coalesce(sum(m.churned_count), 0) = any_value(r.sc)
         AND coalesce(sum(m.retained_count), 0) = any_value(r.sr) AS reconciles
FROM r LEFT JOIN m ON m.tenure_month BETWEEN {SLICE_BOUNDS[0]} AND {SLICE_BOUNDS[1]}""",
    "retention_baseline": _with(B.CUST_UNKNOWN_SQL)
    + """
, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE Churn = 'No') AS r, count(*) FILTER (WHERE Churn = 'Yes') AS c,
             count(*) FILTER (WHERE Churn IS NULL) AS mi,
             count(*) FILTER (WHERE Churn IS NOT NULL AND Churn NOT IN ('No', 'Yes')) AS u FROM cust_unknown)
SELECT n AS total_customers, r AS retained_count, c AS churned_count, mi AS missing_count, u AS unexpected_count,
       coalesce(r / nullif(n, 0) * 100.0, 0.0) AS retained_percent,
       coalesce(c / nullif(n, 0) * 100.0, 0.0) AS churned_percent,
       r - c AS retained_minus_churned,
       coalesce(r / nullif(n, 0) * 100.0, 0.0) - coalesce(c / nullif(n, 0) * 100.0, 0.0) AS retained_minus_churned_percent,
       (mi > 0 OR u > 0) AS has_unexpected_values
FROM t""",
    "status_table": _with(B.CUST_UNKNOWN_SQL)
    + """
, g AS (SELECT v, CAST(sum(w) AS BIGINT) AS n FROM (SELECT Churn AS v, 1 AS w FROM cust_unknown
         UNION ALL SELECT 'No', 0 UNION ALL SELECT 'Yes', 0) GROUP BY v),
tot AS (SELECT count(*) AS n FROM cust_unknown)
SELECT CASE WHEN v = 'No' THEN 'Retained' WHEN v = 'Yes' THEN 'Churned' WHEN v IS NULL THEN 'Missing target value'
            ELSE 'Unexpected: "' || v || '"' END AS status,
       n AS customer_count, coalesce(n / nullif((SELECT n FROM tot), 0) * 100.0, 0.0) AS percent
FROM g
UNION ALL SELECT 'Total', (SELECT n FROM tot), CAST(100.0 AS DOUBLE)""",
    "segment_rates_cust": _r4("(" + _with(B.CUST_SQL) + "SELECT * FROM cust)", "Contract", CUST_SEGMENTS, "Churn", CUST_BASELINE, "contract"),
    "segment_rates_li": _r4("lineitem", "l_linestatus", LI_SEGMENTS, "CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END", LI_BASELINE, "linestatus"),
    "distribution_by_label_cust": _d1("(" + _with(B.CUST_SQL) + "SELECT * FROM cust)", "tenure", "Churn"),
    "distribution_by_label_li": _d1("(" + _with(B.LI_SQL) + "SELECT * FROM li)", "l_quantity", "returned"),
    "population_observations": _with(B.CUST_SQL)
    + "SELECT Churn AS churn_status, CAST(tenure AS DOUBLE) AS tenure FROM cust WHERE Churn IN ('No', 'Yes') AND tenure IS NOT NULL",
    "observed_range": _with(B.CUST_SQL, _obs("cust", "tenure", "Churn", ("No", "Yes")))
    + """
SELECT churn_status, CAST(sum(w) AS BIGINT) AS observation_count, min(m) AS population_min, max(m) AS population_max,
       (SELECT min(m) FROM obs) AS range_min, (SELECT max(m) FROM obs) AS range_max
FROM (SELECT churn_status, m, 1 AS w FROM obs UNION ALL SELECT 'No', NULL, 0 UNION ALL SELECT 'Yes', NULL, 0)
GROUP BY churn_status""",
    "shared_bin_edges": _with(B.CUST_SQL, _obs("cust", "tenure", "Churn", ("No", "Yes")), _bounds_sql(6))
    + "SELECT CAST(i AS BIGINT) AS edge_index, lo + i * 6.0 AS edge FROM bounds, (SELECT unnest(range(0, (SELECT nb FROM bounds) + 1)) AS i)",
    "histogram_by_label": "WITH " + B.CUST_SQL + ",\n" + _d5("cust", "tenure", "Churn", 6)[len("WITH "):],
    "histogram_by_label_li": "WITH " + B.LI_SQL + ",\n" + _d5("li", "l_quantity", "returned", 5)[len("WITH "):],
    "box_plot_stats_cust": "WITH " + B.CUST_SQL + ",\n" + _box_stats("cust", "tenure", "Churn", ("No", "Yes"))[len("WITH "):],
    "box_plot_stats_events": _box_stats("events", "value", "event_type", EVENT_TYPES),
    "box_plot_fliers_events": _box("events", "value", "event_type", EVENT_TYPES)
    + "\nSELECT o.churn_status, o.m AS value FROM obs o JOIN f ON o.churn_status = f.churn_status WHERE o.m < f.lf OR o.m > f.hf",
    "duplicate_rows": "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)",
    "duplicate_rows_lineitem": "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM "
    f"(SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(LI_REPEATED)})",
    "duplicate_ids": "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_ids FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
    "duplicate_texts": "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_ids FROM (SELECT count(*) AS n FROM documents GROUP BY text)",
    "missing_by_column": _missing_sql(),
    "table_shape": _with(B.CUST_SQL) + "SELECT count(*) AS row_count, CAST(5 AS BIGINT) AS column_count FROM cust",
    "schema_profile": _schema_sql(),
    "describe_columns": _describe_sql(),
    "categorical_profile_orders": _profile_sql("orders", ["o_orderstatus", "o_orderpriority"]),
    "categorical_profile_lineitem": _profile_sql("lineitem", ["l_returnflag", "l_linestatus"]),
    "implication_violations": _violations_sql(LI_RULES),
    "implication_support": _support_sql(LI_RULES),
    "numeric_readability": _readability_sql(),
    "class_context": _with(B.CHARGES_SQL)
    + f"SELECT c_nationkey, count(*) AS row_count FROM charges WHERE {_class_sql('TotalCharges')} = 'blank' AND c_nationkey IS NOT NULL GROUP BY c_nationkey",
    "affected_sample": _with(B.CHARGES_SQL)
    + f"""SELECT customerID, c_nationkey, c_acctbal, TotalCharges,
       (SELECT count(*) FROM charges WHERE {_class_sql('TotalCharges')} <> 'convertible') AS affected_count
FROM charges WHERE {_class_sql('TotalCharges')} <> 'convertible' ORDER BY customerID LIMIT 10""",
    "below_minimum": "SELECT 'c_acctbal' AS column_name, CAST(0 AS DOUBLE) AS minimum, min(c_acctbal) AS observed_min, "
    "count(*) FILTER (WHERE c_acctbal < 0) AS below_count FROM customer",
    "below_minimum_values": "SELECT c_acctbal, count(*) AS row_count FROM customer WHERE c_acctbal < 0 GROUP BY c_acctbal",
    "outside_domain": "SELECT l_linenumber, count(*) AS row_count, coalesce(l_linenumber IN (0, 1), false) AS in_domain "
    "FROM lineitem GROUP BY l_linenumber",
    "outside_domain_count": "SELECT 'l_linenumber' AS column_name, count(*) AS row_count, "
    "count(*) FILTER (WHERE NOT coalesce(l_linenumber IN (0, 1), false)) AS outside_count FROM lineitem",
    "range_profile": "SELECT 'p_retailprice' AS column_name, 'double' AS stored_type, count(*) AS row_count, "
    "count(*) FILTER (WHERE p_retailprice IS NULL OR isnan(p_retailprice)) AS missing_count, "
    "min(p_retailprice) AS observed_min, max(p_retailprice) AS observed_max FROM part",
    "domain_conformance": _union_rows(
        [
            f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, CASE WHEN {c} IS NULL THEN 'missing' ELSE 'unexpected' END AS value_status, "
            f"count(*) AS row_count FROM orders WHERE NOT coalesce({c} IN ({', '.join(repr(v) for v in vals)}), false) GROUP BY {c}"
            for c, vals in ORDER_DOMAINS.items()
        ]
    ),
    "product_residual": _residual_sql(),
    **_NAN_SQL,
    "quality_report_charges": _charges_report_sql(),
    "quality_report": _report_sql(),
    "csv_roundtrip": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 5",
}
