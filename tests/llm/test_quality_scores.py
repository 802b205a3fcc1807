"""Every score of a table against a plain quadratic discriminant over statistics counted character by character."""

import math
import zlib

import numpy as np
from __spark_entry__ import queries
from pyspark.sql import functions as F

from segstats.llm import quality
from segstats.sources.tables import load_table

SF_DIR = "/root/testdata/sf0.01"


def plain_statistics(text):
    """The documented statistics, one character and one word at a time."""
    size = len(text.encode()) + 200
    kinds = dict.fromkeys(("upper", "digit", "stop", "mark", "symbol"), 0)
    for ch in text:
        if "A" <= ch <= "Z":
            kinds["upper"] += 1
        elif "0" <= ch <= "9":
            kinds["digit"] += 1
        elif ch in ".,":
            kinds["stop"] += 1
        elif ch in ";:'\"!?()-":
            kinds["mark"] += 1
        elif ch < "\x80" and not ("a" <= ch <= "z") and ch not in " \t\n\r\x0b\x0c":
            kinds["symbol"] += 1
    words = text.split()
    n = len(words) + 30
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    doubled = sum(words[i] == words[i - 1] for i in range(1, len(words)))
    odd = sum(not w[-1].isalnum() and w[-1] not in ".," for w in words)
    root = lambda k, of: math.sqrt(k / of)
    return [
        math.log1p(len(text)),
        math.log1p(sum(len(w) for w in words) / max(1, len(words))),
        root(kinds["upper"], size),
        root(kinds["digit"], size),
        root(kinds["stop"], size),
        root(kinds["mark"], size),
        root(kinds["symbol"], size),
        root(odd, n),
        math.log1p(len(counts) + 30) / math.log1p(n),
        root(doubled, n),
        root(max(counts.values(), default=0), n),
        math.log1p(sum(ch == "\n" for ch in text) / n * 100),
        root(sum(len(w) > 12 for w in words), n),
        root(sum(len(w) < 4 for w in words), n),
        root(sum(w.isupper() for w in words), n),
    ]


def plain_scores(texts, labelled):
    """Scores of ``texts`` from the (text, label) pairs ``labelled``: densities by inverse and determinant."""
    x = np.array([plain_statistics(t) for t, _ in labelled])
    y = np.array([c for _, c in labelled])
    size, z = x.shape[1], np.array([plain_statistics(t) for t in texts])
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * own[c] for c in (0, 1))
    density = []
    for c in (0, 1):
        lean = size / (size + (y == c).sum())
        weight = 0.05 + 0.95 * lean
        cov = (1 - weight) * own[c] + weight * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-4 * np.eye(size)
        d = z - x[y == c].mean(0)
        distance = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        density.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * distance)
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_every_score_of_the_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in load_table(spark, SF_DIR, "documents").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in load_table(spark, SF_DIR, "labels").collect()]
    learnt = [(texts[d], c) for d, c in labels if d in texts and not held(d) and c in (0, 1)]
    want = dict(zip(texts, plain_scores(list(texts.values()), learnt)))
    got = queries()["op6_quality"](spark, SF_DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.7)


def test_the_stage_keeps_what_the_scores_accept(spark):
    docs = load_table(spark, SF_DIR, "documents")
    labels = load_table(spark, SF_DIR, "labels")
    measured = quality.measure(docs)
    model = quality.train(measured, labels)
    accepted = measured.where(quality.score(F.col("features"), model) >= quality.ACCEPT)
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in accepted.select("doc_id").collect())
    originals = {r["doc_id"]: r for r in docs.collect()}
    assert all(r == originals[r["doc_id"]] for r in kept.collect())


def test_statistics_by_hand():
    for text in ("", " ", "Ab c. DEF (x) 12 12 12\nlonger-than-twelve", "é ß — «x»", "x" * 5_000, "\x00\x07 #{}"):
        assert np.allclose(quality.statistics(text), plain_statistics(text), atol=1e-7)  # a root of a rounded difference
