"""The pipeline's stages against plain versions, each on its own input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from segstats.llm import decontaminate
from segstats.sources.tables import load_table

from . import brute

SF_DIR = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, tmp_path):
    docs = load_table(spark, SF_DIR, "documents")
    columns, kinds = docs.columns, docs.dtypes
    inputs, outputs = {}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs[name] = docs
        docs = stage(spark, docs, SF_DIR)
        if name != "packing":
            assert docs.dtypes == kinds
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = outputs[name] = spark.read.parquet(f"{tmp_path}/{k}")

    def rows(df):
        return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    # quality: labelled documents fare by their labels
    labels = {r["doc_id"]: r["quality"] for r in load_table(spark, SF_DIR, "labels").collect()}
    before, after = rows(inputs["quality_classifier"]), rows(outputs["quality_classifier"])
    good = [d in after for d in before if labels.get(d) == 1]
    bad = [d in after for d in before if labels.get(d) == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1

    # near-duplicates: the smallest of each group stays
    before, after = rows(inputs["simhash_near_dedup"]), rows(outputs["simhash_near_dedup"])
    ids = sorted(before)
    assert sorted(after) == sorted(set(brute.components([brute.fingerprint(before[d]) for d in ids], ids)))

    # benchmark copies go, and nothing far from an item does
    before, after = rows(inputs["benchmark_decontamination"]), rows(outputs["benchmark_decontamination"])
    items = [r["text"] for r in load_table(spark, SF_DIR, "benchmark").collect()]
    for d, text in before.items():
        if any(x in text for x in items):
            assert d not in after
        if d not in after:
            words = decontaminate.words_of(text)
            assert any(
                brute.smith_waterman(w, words) >= decontaminate.THRESHOLD * 2 * len(w)
                for w in map(decontaminate.words_of, items)
                if len(set(w) & set(words)) * 2 >= len(set(w))
            )

    # secrets: every document stays, without secrets
    before, after = rows(inputs["secret_scans"]), rows(outputs["secret_scans"])
    assert set(before) == set(after) and not any(brute.secrets(t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if "[redacted]" not in after[d])
    wrong = outputs["secret_scans"].filter(F.col("n_chars") != F.length("text"))
    assert wrong.count() == 0

    # packing: every id once
    before = rows(inputs["packing"])
    found = {}
    for p in outputs["packing"].orderBy("doc_id", "start").collect():
        assert p["start"] == len(found.get(p["doc_id"], []))
        found.setdefault(p["doc_id"], []).extend(np.frombuffer(bytes(p["ids"]), "<u4").tolist())
    assert {d: zlib.crc32(np.array(x, "<u4").tobytes()) for d, x in found.items()} == {
        d: zlib.crc32(brute.ids(t).tobytes()) for d, t in before.items()
    }


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_stages_on_odd_rows(spark):
    from .test_edges import CLASHES, ROWS

    odd = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n_chars long").withColumn("source", F.lit("s"))
    odd = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    for docs in (odd, odd.filter("false")):
        empty = docs is not odd
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            rows = out.collect()
            assert bool(rows) != empty
            if name != "packing":
                assert out.dtypes == docs.dtypes
                assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
