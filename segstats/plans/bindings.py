"""Views over the driver tables that give the operators their column roles.

The driver tables hold no churn table, so three views play its part. Each is
defined twice, identically: as a Spark DataFrame plan (used by the queries)
and as DuckDB SQL (used by the oracle).

* ``cust``: one row per customer. ``tenure`` = whole 30-day months from the
  first order to 2001-08-02; ``Churn`` = 'Yes' when the last order is before
  2001-02-01; ``Contract`` = market segment with AUTOMOBILE read as missing.
  Accounts in debt have no recorded tenure, and deep-debt accounts (a subset)
  no recorded churn either, so missing values occur where the operators must
  tolerate them.
* ``cust_unknown``: ``cust`` with an undocumented label 'Unknown' for one
  nation, for the operators that report unexpected labels.
* ``li``: every line item, labelled ``returned`` = 'Yes' for return flag R.
* ``charges``: customers with the balance stored as text, including blanks,
  a non-numeric token and missing values.
* ``prices``: parts with some retail prices NaN and some missing, a size of
  large whole numbers, the total as text, and a note that is blank for some.

Orders are aggregated per customer *before* the join (a partial aggregate per
scan task, then one row per customer), so the join sees one row per key on
the order side whatever the order count of a single customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.sources.tables import load_table

# --- Fixed values of the views -------------------------------------------------
AS_OF_DATE = "2001-08-02"
CHURN_CUTOFF = "2001-02-01 00:00:00"
DAYS_PER_MONTH = 30
NO_TENURE_BELOW_BALANCE = 0.0
NO_CHURN_BELOW_BALANCE = -500.0
UNKNOWN_LABEL_NATION = 3
MISSING_SEGMENT = "AUTOMOBILE"
# -------------------------------------------------------------------------------


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order")
    )


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer")
    h = order_history(spark, sf_dir)
    j = c.join(h, c["c_custkey"] == h["o_custkey"], "left")
    months = F.floor(
        F.datediff(F.lit(AS_OF_DATE).cast("date"), F.to_date(F.col("first_order"))) / F.lit(DAYS_PER_MONTH)
    ).cast("bigint")
    last = F.col("last_order")
    return j.select(
        F.col("c_custkey").alias("customerID"),
        F.when(F.col("c_acctbal") < NO_TENURE_BELOW_BALANCE, F.lit(None).cast("bigint")).otherwise(months).alias("tenure"),
        F.when(F.col("c_acctbal") < NO_CHURN_BELOW_BALANCE, F.lit(None).cast("string"))
        .when(last.isNull(), F.lit(None).cast("string"))
        .when(last < F.lit(CHURN_CUTOFF).cast("timestamp_ntz"), F.lit("Yes"))
        .otherwise(F.lit("No"))
        .alias("Churn"),
        F.nullif(F.col("c_mktsegment"), F.lit(MISSING_SEGMENT)).alias("Contract"),
        F.col("c_nationkey").alias("nation"),
    )


def cust_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = cust(spark, sf_dir)
    return base.withColumn(
        "Churn",
        F.when(
            (F.col("nation") == UNKNOWN_LABEL_NATION) & F.col("Churn").isNotNull(), F.lit("Unknown")
        ).otherwise(F.col("Churn")),
    )


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = load_table(spark, sf_dir, "lineitem")
    return l.select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_linestatus",
        "l_returnflag",
        F.when(F.col("l_returnflag") == "R", F.lit("Yes")).otherwise(F.lit("No")).alias("returned"),
    )


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer")
    text = (
        F.when(F.col("c_nationkey") == 1, F.lit(None).cast("string"))
        .when(F.col("c_acctbal") < 0, F.lit("  "))
        .when(F.col("c_nationkey") == 0, F.lit("n/a"))
        .otherwise(F.col("c_acctbal").cast("string"))
    )
    return c.select(
        F.col("c_custkey").alias("customerID"), "c_nationkey", "c_acctbal", "c_mktsegment", text.alias("TotalCharges")
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    price = (
        F.when(key % 7 == 0, F.lit(float("nan")))
        .when(key % 11 == 0, F.lit(None).cast("double"))
        .otherwise(F.floor(F.col("p_retailprice") / 100) * 100.0)
    )
    return p.select(
        key.alias("part"),
        price.alias("price"),
        (F.lit(10**15) * (key % 5)).cast("bigint").alias("size"),
        (F.lit(1.0) * key).cast("string").alias("total"),
        F.when(key % 3 == 0, F.lit(" ")).otherwise(F.lit("x")).alias("note"),
    )


# --- The same views for DuckDB --------------------------------------------------

CUST_SQL = f"""
cust AS (
  SELECT c.c_custkey AS customerID,
         CASE WHEN c.c_acctbal < {NO_TENURE_BELOW_BALANCE} THEN NULL
              ELSE CAST(floor(date_diff('day', CAST(h.first_order AS DATE), DATE '{AS_OF_DATE}') / {DAYS_PER_MONTH}) AS BIGINT)
         END AS tenure,
         CASE WHEN c.c_acctbal < {NO_CHURN_BELOW_BALANCE} THEN NULL
              WHEN h.last_order IS NULL THEN NULL
              WHEN h.last_order < TIMESTAMP '{CHURN_CUTOFF}' THEN 'Yes'
              ELSE 'No' END AS Churn,
         nullif(c.c_mktsegment, '{MISSING_SEGMENT}') AS Contract,
         c.c_nationkey AS nation
  FROM customer c
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
             FROM orders GROUP BY o_custkey) h
    ON c.c_custkey = h.o_custkey
)"""

CUST_UNKNOWN_SQL = (
    CUST_SQL
    + f""",
cust_unknown AS (
  SELECT customerID, tenure,
         CASE WHEN nation = {UNKNOWN_LABEL_NATION} AND Churn IS NOT NULL THEN 'Unknown' ELSE Churn END AS Churn,
         Contract, nation
  FROM cust
)"""
)

LI_SQL = """
li AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_linestatus, l_returnflag,
         CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS returned
  FROM lineitem
)"""

CHARGES_SQL = """
charges AS (
  SELECT c_custkey AS customerID, c_nationkey, c_acctbal, c_mktsegment,
         CASE WHEN c_nationkey = 1 THEN NULL
              WHEN c_acctbal < 0 THEN '  '
              WHEN c_nationkey = 0 THEN 'n/a'
              ELSE CAST(c_acctbal AS VARCHAR) END AS TotalCharges
  FROM customer
)"""

PRICES_SQL = """
prices AS (
  SELECT p_partkey AS part,
         CASE WHEN p_partkey % 7 = 0 THEN CAST('NaN' AS DOUBLE)
              WHEN p_partkey % 11 = 0 THEN NULL
              ELSE floor(p_retailprice / 100) * 100.0 END AS price,
         CAST(1000000000000000 * (p_partkey % 5) AS BIGINT) AS size,
         CAST(CAST(p_partkey AS DOUBLE) AS VARCHAR) AS total,
         CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'x' END AS note
  FROM part
)"""
