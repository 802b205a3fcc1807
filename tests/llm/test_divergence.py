"""Source divergence audit against plain sums, with blocks of every size, and odd rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from segstats.llm import divergence


def plain_audit(rows, least_docs=2, top=50):
    docs = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for la, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in mine for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= least_docs)
        counts = {s: Counter(t for _, x, w in mine if x == s for t in w if t in set(kept)) for s in {d[1] for d in mine}}

        def p(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        ps = {s: p(c) for s, c in counts.items()}
        q = p(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(ps[s][t] - q[t], t) for t in kept if counts[s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found[:most], 1)]
    return sorted(out)


def audited(df, **how):
    return sorted(tuple(r) for r in divergence.audit(df, **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["the", "The", "straße", "日本", "été", "x1y"] + [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    made = []
    for i in range(240):
        source = f"s{min(rng.randrange(40), 11)}"  # one source holds most
        some = rng.sample(vocabulary, 12)
        made.append((rng.choice(["en", "de", "fr"]), source, " ".join(rng.choice(some) for _ in range(rng.randrange(30)))))
    return made + [("en", "wordless", None), ("xx", "a", "only once"), ("xx", "b", ""), (None, None, "the the"), ("one", "alone", "the")]


@pytest.mark.parametrize("source_block, term_block", [(1, 3), (4, 1000), (5, 7), (100, 100)])
def test_blocks_of_any_size_give_the_plain_sums(spark, rows, source_block, term_block):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    how = dict(least_docs=2, source_block=source_block, term_block=term_block)
    assert audited(df, **how) == plain_audit(rows)


def test_top_terms_and_no_kept_terms(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audited(df, least_docs=2, top_terms=3) == plain_audit(rows, top=3)
    assert audited(df, least_docs=10**6) == plain_audit(rows, 10**6)


def test_tasks_send_their_counts_in_parts(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    whole = {tuple(r) for r in divergence.term_counts(df).collect()}
    assert {tuple(r) for r in divergence.term_counts(df, held=5).collect()} == whole


def test_repeats_long_texts_clashes_and_empty_tables(spark):
    rows = [("en", "hot", "same words here")] * 70 + [("en", "cold", "other words here")] * 2 + [("en", "long", "here " * 200_000 + "end")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    df = df.withColumns({c: F.lit(f"own {c}") for c in ("term", "n", "docs", "block", "held", "part", "k", "p")})
    assert audited(df, least_docs=2) == plain_audit(rows)
    assert audited(df.filter("false")) == []


def test_probabilities_are_exact_at_any_count(spark):
    n, held, terms = 3 * 10**12, 7 * 10**13, 10**7
    df = spark.createDataFrame([(n, held, terms)], "n long, held long, terms long")
    got = df.select(divergence.probability(F.col("n"), F.col("held"), F.col("terms"))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (held + 5 * terms)
