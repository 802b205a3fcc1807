"""URL filters: rules first, then a character language-model ratio. DataFrame functions alone.

Two smoothed variable-order Markov models are counted over the characters of
all URLs that rules accept and of all that rules reject: a character's
probability backs off from the context of two characters to one and to none as
far as the counts are thin (Witten-Bell). A URL without rule gets the mean log
ratio of its characters and is accepted from a threshold calibrated on the
ruled URLs. The whole model is one table of at most ``SYMBOLS ** 3`` rows, so
it is broadcast, and no URL is shuffled by its characters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import write_table

#: Symbols: 0 is any other character, 1 the end, digits are one symbol; then letters and common marks.
ALPHABET = "$0abcdefghijklmnopqrstuvwxyz./-_~%+="
SYMBOLS = len(ALPHABET) + 1
ORDER = 2


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or if null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or if null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    """Whether a rule's host, or a subdomain of it, serves a path that starts with the rule's."""
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def ruled(pages: DataFrame, rules: list[Rule], url_col: str) -> DataFrame:
    """``pages`` with host, path, rule (text of the longest that fits, else null) and said (its verdict)."""
    host, path = F.col("host"), F.col("path")
    text, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # a longer rule overrides
        text = F.when(fits(r, host, path), F.lit(r.text)).otherwise(text)
        said = F.when(fits(r, host, path), F.lit(r.verdict)).otherwise(said)
    url = F.col(url_col)
    return pages.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("rule", text).withColumn("said", said)


def symbols(text: Column) -> Column:
    """The text's symbols as numbers, two of symbol 1 in front and one behind."""
    low = F.regexp_replace(F.lower(text), "[0-9]", "0")
    chars = F.filter(F.split(F.regexp_replace(low, r"\$", "?"), ""), lambda c: c != "")
    edge = F.lit(1)
    return F.concat(
        F.array(edge, edge), F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c).cast("int")), F.array(edge)
    )


def grams(codes: Column) -> Column:
    """Each symbol with the two before it, as one number."""
    return F.transform(
        F.sequence(F.lit(3), F.size(codes)),
        lambda i: (F.element_at(codes, i - 2) * SYMBOLS + F.element_at(codes, i - 1)) * SYMBOLS + F.element_at(codes, i),
    )


def _backed_off(total: Column, kinds: Column, counts: Column) -> Callable[[Column, Column], Column]:
    """A symbol's probability in a context, from its prior, the one in the next shorter context."""

    def smoothed(prior: Column, symbol: Column) -> Column:
        seen = F.coalesce(F.try_element_at(counts, symbol), F.lit(0.0))
        return F.when(total > 0, (seen + kinds * prior) / (total + kinds)).otherwise(prior)

    return smoothed


def log_ratios(counted: DataFrame) -> DataFrame:
    """(gram, ratio) for every possible gram: log p(accepted) - log p(rejected), from (said, gram, n).

    Counts are added up for each context of no, one and two symbols (``SYMBOLS ** 2``
    contexts of the longest, each with its symbols' counts); then the chain of
    probabilities is worked out from the shortest context to the longest.
    """
    tails = F.array(*[F.col("gram") % SYMBOLS ** (order + 1) for order in range(ORDER + 1)])
    held = counted.select("said", "n", F.posexplode(tails).alias("order", "tail"))
    held = held.groupBy("said", "order", "tail").agg(F.sum("n").cast("double").alias("n"))
    context = F.floor(F.col("tail") / SYMBOLS).cast("int").alias("context")
    each = F.struct((F.col("tail") % SYMBOLS).cast("int").alias("symbol"), "n")
    sides = ("allow", "block")
    contexts = held.groupBy("order", context).agg(
        *[
            column
            for side in sides
            for column in (
                F.coalesce(F.sum(F.when(F.col("said") == side, F.col("n"))), F.lit(0.0)).alias(f"{side}_all"),
                F.count_if(F.col("said") == side).cast("double").alias(f"{side}_kinds"),
                F.map_from_entries(F.collect_list(F.when(F.col("said") == side, each))).alias(f"{side}_held"),
            )
        ]
    )
    grid = counted.sparkSession.range(SYMBOLS**ORDER).select(F.col("id").cast("int").alias("longest"))
    chain = {side: F.array_repeat(F.lit(1.0 / SYMBOLS), SYMBOLS) for side in sides}
    for order in range(ORDER + 1):
        own = contexts.filter(F.col("order") == order).drop("order")  # SYMBOLS ** order rows at most
        own = own.withColumnsRenamed({c: f"{c}_{order}" for c in own.columns})
        grid = grid.join(
            F.broadcast(own), F.col("longest") % SYMBOLS**order == F.col(f"context_{order}"), "left"
        )
        for side in sides:
            seen = [F.col(f"{side}_{x}_{order}") for x in ("all", "kinds", "held")]
            grid = grid.withColumn(f"{side}_{order}", F.transform(chain[side], _backed_off(*seen)))
            chain[side] = F.col(f"{side}_{order}")
    ratios = F.zip_with(chain["allow"], chain["block"], lambda x, y: F.log(x) - F.log(y))
    found = grid.select("longest", F.posexplode(ratios).alias("symbol", "ratio"))
    return found.select((F.col("longest") * SYMBOLS + F.col("symbol")).alias("gram"), "ratio")


def judged(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and score.

    ``score`` is the mean log ratio of the URL's characters (host and path);
    the verdict is the rule's, else allow from the calibrated threshold on: the
    point between the mean scores of accepted and of rejected URLs that lies as
    many standard deviations from either. While rules leave one of the two
    without URLs, URLs without rule are allowed. Null URLs and those without
    ``://`` have empty host and path and are scored as such; repeated URLs are
    scored once; an empty table stays empty. Columns of ``pages`` named like
    the results are replaced.
    """
    names = ("host", "path", "rule", "said", "score", "verdict")
    wanted = [c for c in pages.columns if c.lower() not in names]
    known = ruled(pages.select(*wanted), rules, url_col)
    texts = known.groupBy("host", "path", "said").agg(F.count("*").alias("n"))
    texts = write_table(texts.withColumn("codes", symbols(F.concat("host", "path"))), "url-texts")
    counted = (
        texts.filter("said is not null")
        .select("said", "n", F.explode(grams(F.col("codes"))).alias("gram"))
        .groupBy("said", "gram")
        .agg(F.sum("n").alias("n"))
    )
    ratios = write_table(log_ratios(counted), "url-model")
    each = texts.select("host", "path", "said", "n", F.explode(grams(F.col("codes"))).alias("gram"))
    scored = (
        each.join(F.broadcast(ratios), "gram")  # SYMBOLS ** 3 rows of 12 bytes
        .groupBy("host", "path", "said", "n")
        .agg(F.avg("ratio").alias("score"))
    )
    scored = write_table(scored, "url-scores")
    threshold = calibrated(scored)
    by_method = F.when(F.lit(threshold).isNull() | (F.col("score") >= F.lit(threshold)), "allow").otherwise("block")
    scores = scored.filter("said is null").select("host", "path", "score")
    # only URLs without rule need a score: a hot ruled host is not joined at all
    free = known.filter("said is null").join(scores, ["host", "path"], "left").withColumn("verdict", by_method)
    own = known.filter("said is not null").withColumns({"score": F.lit(None).cast("double"), "verdict": F.col("said")})
    columns = [*wanted, "host", "path", "rule", "score", "verdict"]
    return free.select(*columns).unionByName(own.select(*columns))


def calibrated(scored: DataFrame) -> float | None:
    """The threshold from the scores of ruled URLs; None when rules leave one side empty."""
    n, x = F.col("n"), F.col("score")
    rows = (
        scored.filter("said is not null")
        .groupBy("said")
        .agg((F.sum(n * x) / F.sum(n)).alias("mean"), (F.sum(n * x * x) / F.sum(n)).alias("square"))
        .collect()
    )
    side = {r["said"]: (r["mean"], max(r["square"] - r["mean"] ** 2, 0.0) ** 0.5) for r in rows}
    if len(side) < 2:
        return None
    (a, da), (b, db) = side["allow"], side["block"]
    return (a * db + b * da) / (da + db) if da + db > 0 else (a + b) / 2
