"""Q14, Q16 with a domain given as a table: the same rows as with a list, at any size of the domain."""

from pyspark.sql import functions as F

from conftest import rows
from segstats.operators.quality import domain_conformance, outside_domain, outside_domain_count

NAN = float("nan")


def table(spark):
    made = [(k % 7, f"v{k % 5}", 0.5 * (k % 3)) for k in range(60)] + [(None, None, NAN), (3, "", None)]
    return spark.createDataFrame(made, "a int, b string, c double").repartition(3)


def domains(spark):
    lists = {"a": [0, 1, 3, 99], "b": ["v1", "v3"], "c": [0.0, 1.0]}
    kinds = {"a": "int", "b": "string", "c": "double"}
    odd = {"a": None, "b": None, "c": NAN}
    tables = {
        c: spark.createDataFrame([(v,) for v in [*vals, *vals, odd[c]]], f"allowed {kinds[c]}") for c, vals in lists.items()
    }
    return lists, tables


def test_a_table_gives_the_rows_of_a_list(spark):
    df = table(spark)
    lists, tables = domains(spark)
    for c in lists:
        assert rows(outside_domain(df, c, tables[c])) == rows(outside_domain(df, c, lists[c]))
        assert rows(outside_domain_count(df, c, tables[c])) == rows(outside_domain_count(df, c, lists[c]))
    want = rows(domain_conformance(df, lists))
    assert rows(domain_conformance(df, tables)) == want
    assert rows(domain_conformance(df, {"a": lists["a"], "b": tables["b"], "c": lists["c"]})) == want
    assert rows(domain_conformance(df, {})) == []


def test_empty_tables_and_domains(spark):
    df = table(spark)
    none = spark.createDataFrame([], "allowed int")
    assert not any(r["in_domain"] for r in rows(outside_domain(df, "a", none)))
    assert rows(outside_domain_count(df.where("false"), "a", none)) == [{"column_name": "a", "row_count": 0, "outside_count": 0}]
    assert rows(domain_conformance(df.where("false"), {"a": none})) == []


def test_a_million_values_are_no_literals(spark):
    df = spark.range(2000).select((F.col("id") * 600).alias("x"))
    domain = spark.range(1_000_000).select(F.col("id").alias("allowed"))
    got = outside_domain(df, "x", domain)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and " IN (" not in plan and len(plan) < 20_000
    inside = sum(600 * k < 1_000_000 for k in range(2000))
    assert rows(got.groupBy("in_domain").count().orderBy("in_domain")) == [
        {"in_domain": False, "count": 2000 - inside}, {"in_domain": True, "count": inside},
    ]
    assert rows(outside_domain_count(df, "x", domain))[0]["outside_count"] == 2000 - inside
    assert domain_conformance(df, {"x": domain}).count() == 2000 - inside


def test_the_join_is_left_to_the_measured_size(spark):
    """Beyond the threshold neither side is broadcast."""
    df = spark.range(2000).select(F.col("id").alias("x"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = outside_domain(df, "x", spark.range(100))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" not in plan
