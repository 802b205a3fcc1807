"""Nulls, empty and very long texts, repeated rows, empty tables, clashing column names: defined results, no crash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.llm import decontaminate, html_text, packing, quality, secrets, simhash, token_counts, token_files, topk, urls
from segstats.llm.queries import RULES

from . import brute

LONG = "the quick word and " * 20_000
ROWS = [
    (1, "a plain text of some words", "en", 3),
    (1, "a plain text of some words", "en", 3),
    (None, "a plain text of some words", None, None),
    (2, None, "de", 0),
    (3, "", "de", 0),
    (3, "another text under the same id", "de", 0),
    (None, None, None, None),
    (4, LONG, "fr", 9),
]
#: Extra columns named like results and helpers of the operators.
CLASHES = "n_tokens matches secrets features score fp root component_id text_hash ids part before start _is_query".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def kept_own(df):
    return all(r[c] == f"own {c}" for r in df.select(*CLASHES).collect() for c in CLASHES)


def test_packing(docs, empty):
    pieces = packing.pack(docs, brute.VOCABULARY, 4096).collect()
    assert sum(p["length"] for p in pieces) == sum(len(brute.ids(t)) for _, t, *_ in ROWS)
    assert sorted({p["sequence_id"] for p in pieces}) == list(range(len({p["sequence_id"] for p in pieces})))
    assert packing.pack(empty, brute.VOCABULARY, 4096).count() == 0


def test_token_files(spark, docs, empty):
    rows = token_files.read_token_files(spark, token_files.write_token_files(docs, brute.VOCABULARY)).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 2, 3, 3, 4]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert sorted(bytes(r["ids"]) for r in rows) == sorted(brute.ids(t).tobytes() for _, t, *_ in ROWS)
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, brute.VOCABULARY)).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame(
        [(7, "a plain text of some words"), (8, None), (None, "another text under the same id"), (9, "")],
        "item_id long, text string",
    ).withColumn("matches", F.lit(0))
    found, name = decontaminate.with_matches(docs, bench)
    assert name == "_matches" and kept_own(found)
    got = [(r["doc_id"], [m["item_id"] for m in r[name]]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(
        [(1, [7]), (1, [7]), (None, [7]), (2, []), (3, []), (3, [None]), (None, []), (4, [])], key=str
    )
    assert decontaminate.with_matches(empty, bench)[0].count() == 0
    none, name = decontaminate.with_matches(docs, bench.filter("false"))
    assert [r[name] for r in none.collect()] == [[]] * len(ROWS)


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    prints = [brute.fingerprint(t) for _, t, *_ in ROWS]
    want = brute.components(prints, [i for i, *_ in ROWS])
    assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in rows if r["doc_id"]) == sorted(
        (i, p, c) for (i, *_), p, c in zip(ROWS, prints, want) if i
    )
    assert len(rows) == len(ROWS) and simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept_own(kept)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert simhash.keep_one(empty).count() == 0


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (None, "other text of words here")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(df).collect()] == [None] * 3
    assert sorted(r["text"] for r in simhash.keep_one(df).collect()) == ["other text of words here", "x y z"]


def test_token_counts(docs, empty):
    counted, name = token_counts.with_token_counts(docs, brute.VOCABULARY, table_words=3)
    assert name == "_n_tokens" and kept_own(counted)
    got = sorted(r[name] for r in counted.collect())
    assert got == sorted(brute.n_tokens(t) for _, t, *_ in ROWS)
    assert token_counts.with_token_counts(empty, brute.VOCABULARY)[0].count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame(
        [(1, 1), (3, 0), (3, 0), (4, 1), (4, None), (4, 5), (None, 1), (99, 0)], "doc_id long, quality int"
    ).withColumn("features", F.lit(1))
    plain = docs.drop("features")
    measured = quality.measure(plain)
    model = quality.train(measured, labels)
    scores = [r["s"] for r in measured.select(quality.score(F.col("features"), model).alias("s")).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and kept_own(kept)
    assert quality.train(measured, labels.filter("false")) == 0.5
    assert quality.train(measured, labels.filter("quality = 1")) == pytest.approx(4 / 5)
    assert quality.keep_accepted(docs, labels.filter("quality = 1")).count() == len(ROWS)
    assert quality.keep_accepted(empty, labels).count() == 0
    assert all(np.isfinite(quality.statistics(t)).all() for t in ("", " ", "\n", "\ud800", "x" * 10**6))


def test_main_text(spark):
    rows = [(1, None), (2, ""), (2, "<p>a paragraph"), (3, "<" * 5000), (4, "<div>" * 20_000 + "x" + "</b>" * 20_000), (None, "<article>&amp;lt;")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("own"))
    found, name = html_text.with_main_text(pages)
    assert name == "_text"
    got = {(r["page_id"], r["html"]): r[name] for r in found.collect()}
    assert [got[r] for r in rows] == ["", "", "a paragraph", "", "", "&lt;"]
    assert html_text.with_main_text(pages.filter("false"))[0].count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]),
        (None, [1.0, 2.0]), (100, [1.0]), (101, [2.0]), (200, []), (201, []), (300, [3e38, 3e38, 1.0]), (301, [3e38, 3e38, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)).withColumn("v", F.lit(0))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    five = 1024 * 1024 * 5
    assert got == [
        (0, 1, 1, five), (0, 2, 1, five), (100, 1, 101, 2 * 1024 * 1024), (200, 1, 201, 0), (300, 1, 301, (1 << 63) - 1),
    ]
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") == -1).count() == 0


def test_secrets(docs, empty):
    found, name = secrets.with_spans(docs)
    assert name == "_secrets" and kept_own(found)
    assert all(r[name] == [] for r in found.collect())
    assert secrets.with_spans(empty)[0].count() == 0
    assert sorted(map(str, secrets.redacted(docs).collect())) == sorted(map(str, docs.collect()))


def test_secrets_in_a_very_long_text(spark):
    text = ("password=abcdef123 " + "plain words here " * 40) * 300
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found, name = secrets.with_spans(df)
    assert len(found.first()[name]) == 300
    assert secrets.redacted(df).first()["text"] == text.replace("password=abcdef123", "[redacted]")


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (1, None), (None, "http://a.net/x")], "page_id long, url string")
    pages = pages.withColumn("score", F.lit("own")).withColumns({c: F.lit(f"own {c}") for c in ("codes", "_h", "_p", "n", "gram")})
    rows = urls.judged(pages, RULES).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in rows) == [(0, "block"), (1, "allow"), (1, "allow")]
    assert all(r[c] == f"own {c}" for r in rows for c in ("codes", "_h", "_p", "n", "gram"))
    assert urls.judged(pages.filter("false"), RULES).count() == 0


def test_secrets_take_time_in_proportion_to_the_text(spark):
    """A megabyte of prose with one hex string, and one with very many matches: a list copied at every match took minutes."""
    import time

    prose = "some plain prose here " * 45_000 + "deadbeef" * 4
    many = "token=abcdef12 x " * 60_000
    df = spark.createDataFrame([(1, prose), (2, many)], "doc_id long, text string")
    secrets.with_spans(df.limit(0))[0].collect()
    began = time.time()
    found, name = secrets.with_spans(df)
    got = {r["doc_id"]: r[name] for r in found.collect()}
    assert time.time() - began < 60
    assert [(s["start"], s["end"]) for s in got[1]] == [(len(prose) - 32, len(prose))]
    assert [(s["start"], s["end"]) for s in got[2]] == [(17 * k, 17 * k + 14) for k in range(60_000)]
