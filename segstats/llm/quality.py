"""Quality classifier: regularised quadratic discriminant analysis.

Transformed statistics of a document (shares of character classes, repetition,
lengths) are modelled by one Gaussian per class. Each class covariance is
shrunk towards the pooled one and its diagonal; scores come from the
difference of the Mahalanobis log densities. The inverses of the covariances'
Cholesky factors are made once and sent to the tasks, where a batch of
documents takes one triangular product per class.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import fresh_name, prepare_workers, text_of, write_table

_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SPACE, _STOPS, _MARKS = b" \t\n\r\x0b\x0c", b".,", b";:'\"!?()-"
_ASCII = bytes(range(128))
#: Added to the sizes that shares divide by.
PRIOR_BYTES, PRIOR_WORDS = 200, 30

FEATURES = (
    "log_chars", "log_word_length", "upper", "digits", "stops", "marks", "symbols", "symbol_words", "heaps",
    "doubled", "top_word", "lines", "long_words", "short_words", "upper_words",
)
#: Weight of the pooled covariance and of the diagonal; score from which a document is accepted.
SHRINK, RIDGE, ACCEPT = 0.05, 0.05, 0.7


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; all finite, also for the empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw) + PRIOR_BYTES  # short texts' shares lean towards zero: few characters say little

    def share(kind: bytes) -> float:
        return (len(raw) - len(raw.translate(None, kind))) / size

    lower, upper, digits, space = share(_LOWER), share(_UPPER), share(_DIGITS), share(_SPACE)
    stops, marks = share(_STOPS), share(_MARKS)
    other = (len(raw) - len(raw.translate(None, _ASCII))) / size  # bytes of symbols and control characters
    other = max(0.0, other - lower - upper - digits - space - stops - marks)
    words = text.split()
    n = len(words) + PRIOR_WORDS
    seen = Counter(words)
    doubled = sum(map(eq, words, words[1:])) / n
    top = max(seen.values()) / n if seen else 0.0
    letters = sum(map(len, words)) / max(1, len(words))
    odd = sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ".,") / n
    long = sum(c for w, c in seen.items() if len(w) > 12) / n
    short = sum(c for w, c in seen.items() if len(w) < 4) / n
    caps = sum(c for w, c in seen.items() if w.isupper()) / n
    return [
        math.log1p(len(text)),
        math.log1p(letters),
        math.sqrt(upper),
        math.sqrt(digits),
        math.sqrt(stops),
        math.sqrt(marks),
        math.sqrt(other),
        math.sqrt(odd),
        math.log1p(len(seen) + PRIOR_WORDS) / math.log1p(n),
        math.sqrt(doubled),
        math.sqrt(top),
        math.log1p(text.count("\n") / n * 100),
        math.sqrt(long),
        math.sqrt(short),
        math.sqrt(caps),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the covariance, log prior minus half the log determinant."""

    means: tuple[np.ndarray, np.ndarray]
    whitenings: tuple[np.ndarray, np.ndarray]  # inverses of the shrunk covariances' lower Cholesky factors
    offsets: tuple[float, float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row."""
        density = [
            offset - 0.5 * (((x - mean) @ whitening.T) ** 2).sum(axis=1)
            for mean, whitening, offset in zip(self.means, self.whitenings, self.offsets)
        ]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def fit(
    moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE
) -> Discriminant | float:
    """The discriminant from each class's (rows, sums, sums of products).

    With no rows at all the score is 0.5 everywhere, with one class only it is
    the prior with one row of the other class assumed: a float is returned then.
    """
    total = sum(m[0] for m in moments.values())
    if len(moments) < 2:
        return (moments[1][0] + 1) / (total + 2) if 1 in moments else 1 / (total + 2) if 0 in moments else 0.5
    means = {c: s / n for c, (n, s, _) in moments.items()}
    spread = {c: p / n - np.outer(means[c], means[c]) for c, (n, _, p) in moments.items()}
    pooled = sum(moments[c][0] * spread[c] for c in (0, 1)) / total
    size = len(pooled)
    whitenings, offsets = [], []
    for c in (0, 1):
        n = moments[c][0]
        weight = shrink + (1 - shrink) * size / (size + n)  # few rows lean on the pooled covariance
        cov = (1 - weight) * spread[c] + weight * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(np.diag(cov)) + 1e-4 * np.eye(size)
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        whitenings.append(np.tril(np.linalg.inv(factor)))
        offsets.append(float(math.log(n / total) - np.log(np.diag(factor)).sum()))
    return Discriminant((means[0], means[1]), tuple(whitenings), tuple(offsets))


def features(text: Column) -> Column:
    """A column of document statistics (array of doubles, ``FEATURES`` in order)."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        rows = [statistics(t) for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.float64()))

    return of(text)


def moments(rows: DataFrame, label: str, column: str, weight: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, sums and sums of products of the statistics per class, each row counted ``weight`` times.

    One aggregate over all rows with partial sums in the tasks; two result rows.
    """
    size = len(FEATURES)
    x, w = [F.col(column)[i] for i in range(size)], F.col(weight)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(w * v).alias(f"s{i}") for i, v in enumerate(x)]
    sums += [F.sum(w * x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.groupBy(label).agg(F.sum(w).alias("n"), *sums).collect():
        products = np.zeros((size, size))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        out[int(r[label])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(size)]), products)
    return out


def train(measured: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id") -> Discriminant | float:
    """The classifier from measured documents (``id_col``, ``features``) and ``labels`` (``id_col``, ``quality``).

    ``learn`` says which label rows may be used (all by default). Labels that
    are null or neither 0 nor 1, and labels or documents without partner, are
    not used; repeated labels count repeatedly, but are counted per document
    before the join, so that an id repeated on both sides does not multiply.
    Without labels, or with one class alone, every score is a constant (see
    ``fit``).
    """
    usable = labels if learn is None else labels.filter(learn)
    quality = F.col("quality").cast("int")
    votes = usable.groupBy(F.col(id_col).alias("_id")).agg(*[F.count_if(quality == c).alias(f"_n{c}") for c in (0, 1)])
    known = measured.select(F.col(id_col).alias("_id"), "features").join(votes, "_id")
    classes = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"_n{c}").alias("n")) for c in (0, 1)])
    each = known.select("features", F.explode(classes).alias("v")).select("features", "v.c", "v.n").filter("n > 0")
    return fit(moments(each, "c", "features", "n"))


def score(features_column: Column, model: Discriminant | float) -> Column:
    """Probability of label 1 for each row's statistics."""
    if isinstance(model, float):
        return F.lit(model)

    @F.arrow_udf("double")
    def of(rows: pa.Array) -> pa.Array:
        x = rows.values.to_numpy(zero_copy_only=False)[rows.offset * len(FEATURES) :]
        return pa.array(model.score(x[: len(rows) * len(FEATURES)].reshape(len(rows), len(FEATURES))))

    return of(features_column)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) of every document, written once: what training and scoring read.

    Null texts are empty ones, and the empty text has finite statistics;
    repeated rows and null ids have a row each; an empty table gives none;
    other columns are not read. Very long texts are measured whole.
    """
    prepare_workers(docs.sparkSession)
    return write_table(docs.select(F.col(id_col), features(text_of(text_col)).alias("features")), "quality-features")


def keep_accepted(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    accept: float = ACCEPT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without the documents scored below ``accept``; columns unchanged.

    Null texts are empty ones; empty and very long texts are scored like any
    other; repeated rows fare alike; an empty table stays empty. When the
    labels hold fewer than two classes there is nothing to tell apart and every
    document stays. Documents are written once with their statistics, so texts
    are measured once, for learning and for scoring.
    """
    prepare_workers(docs.sparkSession)
    name = fresh_name("_features", docs.columns)
    measured = write_table(docs.withColumn(name, features(text_of(text_col))), "quality-measured")
    model = train(measured.select(id_col, F.col(name).alias("features")), labels, learn, id_col)
    if isinstance(model, float):
        return docs
    return measured.filter(score(F.col(name), model) >= accept).drop(name)
