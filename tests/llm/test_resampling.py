"""Importance resampling: composed CRCs against built strings, weights and draws against plain ones, odd rows."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.llm import resampling

from .test_operators import ODD_TEXTS


def plain_buckets(text, buckets=10_000):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)


def scanned_buckets(dictionary, texts, limit):
    words, found = Counter(), [Counter() for _ in texts]
    for owner, runs, before in resampling.scanned(dictionary, [t and t.encode() for t in texts], 10_000, limit):
        words.update(owner.tolist())
        for longer, bucket in enumerate(runs):
            for k, b in zip(owner[before >= longer].tolist(), bucket[before >= longer].tolist()):
                found[k][b] += 1
    return [(words[k], found[k]) for k in range(len(texts))]


def random_texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "Bc", "É", "straße", "日本語", "x1", "99", "word", "q" * 90] + [f"w{i}" for i in range(300)]
    marks = [" ", "  ", "-", ".\n", "\x00", "_", "\x7f", "'"]
    return ["".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("limit", [1, 7, 40, 1 << 20])
@pytest.mark.parametrize("room", [30, 1 << 20])
def test_scans_give_the_buckets_of_the_runs(limit, room):
    texts = random_texts(limit) + [t for t in ODD_TEXTS[:-1]] + random_texts(room) + ["z" * 5000 + " b " + "y" * 3000]
    dictionary = resampling.Dictionary(room)
    for _ in range(2):  # the second time all words are known
        assert scanned_buckets(dictionary, texts, limit) == [plain_buckets(t) for t in texts]


def test_crcs_move_on_by_any_length():
    shifts = resampling.Shifts()
    for n in (0, 1, 2, 3, 8, 255, 256, 70_001):
        c = np.array([zlib.crc32(b"left"), 0, 0xFFFFFFFF], "u4")
        moved = shifts.shifted(c, np.full(3, shifts.place(n), "i4"))
        assert moved[0] ^ zlib.crc32(b"r" * n) == zlib.crc32(b"left" + b"r" * n) and moved[1] == 0


def plain_draw(docs, target):
    found = [(d, *plain_buckets(t)) for d, t in docs]
    source, aim = Counter(), Counter()
    for _, _, c in found:
        source.update(c)
    for t in target:
        aim.update(plain_buckets(t)[1])
    s_all, t_all = sum(source.values()), sum(aim.values())

    def gain(b):
        return math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000))))

    rows = []
    for d, words, c in found:
        weight = sum(n * gain(b) for b, n in c.items())
        h = int(sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, sum(c.values()), weight, score, words >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return sorted([*map(str, r[:4]), str(rank.get(id(r)))] for r in rows)


def drawn(docs, target):
    weighted, name = resampling.with_weights(docs, target)
    rows = resampling.draw(weighted.drop("text"), name).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted([str(v) for v in r] for r in rows.collect())


def test_weights_scores_and_draw(spark):
    texts = random_texts(5, 150) + ODD_TEXTS
    docs = [(i, t) for i, t in enumerate(texts)]
    target = random_texts(6, 9)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate([*target, None])], "item_id long, text string")
    assert drawn(df, aim) == plain_draw(docs, target)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(None, None), (1, ""), (1, "x y z"), (1, "x y z"), (None, "w " * 30), (2, "- . -")] + [(7, "hot words " * 15)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aim = spark.createDataFrame([("hot words",)], "text string")
    assert drawn(docs, aim) == plain_draw(rows, ["hot words"])
    assert drawn(docs, aim.filter("false")) == plain_draw(rows, [])
    assert drawn(docs.filter("false"), aim) == []
    own = docs.withColumns({c: F.lit(f"own {c}") for c in ("importance", "_may", "_salt", "bucket", "n")})
    weighted, name = resampling.with_weights(own, aim)
    assert name == "_importance" and weighted.columns == [*own.columns, name]
    result = resampling.draw(weighted, name)
    assert all(r[c] == f"own {c}" for r in result.collect() for c in ("importance", "_may", "_salt", "bucket", "n"))
    taken = resampling.draw(resampling.with_weights(docs.withColumn("Score", F.lit(1)), aim)[0], "importance")
    assert taken.columns == ["doc_id", "text", "n_features", "weight", "score", "rank"]


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(400_000))
    got = resampling.with_weights(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("w1",)], "text string"))
    part = got[0].first()[got[1]]
    assert (part["n_words"], part["n_features"]) == (400_000, 3 * 400_000 - 3)
