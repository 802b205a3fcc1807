"""The streaming counts agree with the batch operator on the same rows."""

from conftest import rows
from segstats import rate_by_value
from segstats.session import shared_dir
from segstats.streaming import stream_rate_by_value

SCHEMA = "tenure bigint, Churn string"


def test_stream_matches_batch(spark):
    data = [(0, "No"), (1, "Yes"), (1, "No"), (2, "Yes"), (2, "Yes"), (2, "No"), (None, "Yes")]
    src = shared_dir(spark, "stream-src")
    spark.createDataFrame(data[:4], SCHEMA).write.parquet(src + "/a")
    spark.createDataFrame(data[4:], SCHEMA).write.parquet(src + "/b")
    stream = spark.readStream.schema(SCHEMA).parquet(src + "/*")
    q = (
        stream_rate_by_value(stream)
        .writeStream.format("memory")
        .queryName("rate_stream")
        .outputMode("complete")
        .option("checkpointLocation", shared_dir(spark, "stream-ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    got = {r["tenure_month"]: r for r in rows(spark.table("rate_stream"))}
    batch = rows(rate_by_value(spark.createDataFrame(data, SCHEMA)))
    for b in batch:
        s = got[b["tenure_month"]]
        assert (s["customer_count"], s["churned_count"], s["retained_count"]) == (
            b["customer_count"], b["churned_count"], b["retained_count"],
        )
        assert s["unclassified_count"] == 0 and s["unexpected_label_count"] == 0


def test_stream_segment_counts_match_batch(spark):
    from segstats import segment_rates
    from segstats.streaming import stream_segment_counts

    schema = "Contract string, Churn string"
    data = [("One year", "Yes"), ("One year", "No"), (None, "Yes"), ("Weekly", "No"), ("Two year", None)]
    src = shared_dir(spark, "stream-seg")
    spark.createDataFrame(data, schema).write.parquet(src + "/a")
    q = (
        stream_segment_counts(spark.readStream.schema(schema).parquet(src + "/*"))
        .writeStream.format("memory")
        .queryName("segment_stream")
        .outputMode("complete")
        .option("checkpointLocation", shared_dir(spark, "stream-seg-ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    got = {r["contract"]: (r["customer_count"], r["churned_count"]) for r in rows(spark.table("segment_stream"))}
    batch = {
        r["contract"]: (r["customer_count"], r["churned_count"])
        for r in rows(segment_rates(spark.createDataFrame(data, schema), 50.0))
        if r["customer_count"] > 0
    }
    assert got == batch
