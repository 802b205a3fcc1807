"""Source divergence audit: how far the sources of a language stand apart in their terms, exactly.

Terms are counted per (language, source) in the tasks; a language keeps the
terms in enough of its documents. The sum over all kept terms for every pair
of sources is a product of three axes, sources x sources x terms, which is cut
into cells (source block, source block, term block). A task owns a cell: it gets the
two slices of counts that meet there, replicated once for each block they meet,
fills them up with the probability of an absent term, and sends partial sums of each pair of
its sources; partial sums are added along the term axis. No task sees more
than two source blocks of one term block, however many terms or sources there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.common import prepare_workers, text_of, write_table

SCALE, PRIOR, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 5, 30, 50
#: Sources in a source block and terms in a term block, on average (blocks are dealt by hash).
SOURCE_BLOCK, TERM_BLOCK = 16, 512
#: Distinct terms that a task holds before it sends its counts.
HELD_TERMS = 200_000

#: Term characters are letters and all beyond ASCII, A-Z lower-cased; every other byte is a delimiter.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = HELD_TERMS
) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents holding the term; an empty term marks each group.

    Tasks add up their documents and send counts when they hold ``held`` terms.
    """
    prepare_workers(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def sent(total: dict, holding: dict) -> pa.RecordBatch:
        rows = [(*g, t, n, holding[g][t]) for g, terms in total.items() for t, n in terms.items()]
        columns = list(zip(*rows)) or [()] * len(names)
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, Counter] = {}
        holding: dict[tuple, Counter] = {}
        for batch in batches:
            size = sum(map(len, total.values()))
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                g = (lang, source)
                if g not in total:
                    total[g], holding[g] = Counter({b"": 0}), Counter({b"": 0})
                terms = text.translate(_FOLD).split()
                size -= len(total[g])
                total[g].update(terms)
                holding[g].update(set(terms))
                size += len(total[g])
                if size > held:
                    yield sent(total, holding)
                    total, holding, size = {}, {}, 0
        yield sent(total, holding)

    read = docs.select(
        text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).cast("binary").alias("text")
    )
    sums = read.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return (
        sums.groupBy("lang", "source", F.col("term").cast("string").alias("term"))
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (N + 5 V)), exact at any count; without kept terms (V = 0) no sum asks for it."""
    wide = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = F.greatest(total + F.lit(PRIOR) * terms, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", wide, under) + 1


def _cells(slices: DataFrame, blocks: Column, keys: list[str]) -> DataFrame:
    """Every row once for each cell that its source block (``block``) meets: (lang, i, j, k) with i <= j."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_other")
    return slices.select("*", other).select(
        F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), *keys
    )


def _cell_sums(cell: pa.Table) -> pa.Table:
    """One cell's partial sums: every pair of its sources that meet here."""
    lang, i, j = (cell.column(c)[0].as_py() for c in ("lang", "i", "j"))
    term = cell.column("term")
    is_group = np.asarray(term.is_null())
    groups = cell.filter(pa.array(is_group))
    names, block = groups.column("source").to_pylist(), np.array(groups.column("block").to_pylist(), "i8")
    absent = np.array(groups.column("p").to_pylist(), "i8")
    size = groups.column("terms")[0].as_py()  # kept terms in this term block
    counted = cell.filter(pa.array(~is_group))
    coded = counted.column("term").combine_chunks().dictionary_encode()
    seen = len(coded.dictionary)
    p = np.repeat(absent[:, None], seen, axis=1)
    if seen:
        place = {n: k for k, n in enumerate(names)}
        at = [place[n] for n in counted.column("source").to_pylist()]
        p[at, coded.indices.to_numpy(zero_copy_only=False)] = np.array(counted.column("p").to_pylist(), "i8")
    left = np.flatnonzero(block == i)
    right = np.flatnonzero(block == j)
    a, b, f = [], [], []
    for x in left.tolist():
        others = right[right > x] if i == j else right
        part = np.abs(p[others] - p[x]).sum(axis=1) + (size - seen) * np.abs(absent[others] - absent[x])
        a += [names[x]] * len(others)
        b += [names[y] for y in others.tolist()]
        f += part.tolist()
    return pa.table(
        {
            "lang": pa.array([lang] * len(a), pa.string()),
            "a": pa.array(a, pa.string()),
            "b": pa.array(b, pa.string()),
            "value": pa.array(f, pa.int64()),
        }
    )


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
    source_block: int = SOURCE_BLOCK,
    term_block: int = TERM_BLOCK,
) -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    Part ``pair``: every other source of the language and the sum over the
    language's kept terms of the difference of probabilities, all ranks. Part
    ``term``: the terms that the source holds and uses more than its language
    does, by that difference, up to ``top_terms``. Ranks are by value, then by
    item in UTF-8 order. Null texts, languages and sources read as empty ones;
    a source without terms has the probability of absent terms throughout; a
    language without kept terms has value 0 for each pair and no term rows; a
    language of one source has no pair rows. Repeated rows are documents like any other; other
    columns are not read. An empty table gives no rows.
    """
    counts = write_table(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    occurring = counts.filter("term = ''").select("lang", "source")
    by_term = (
        counts.filter("term <> ''")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("_docs"), F.sum("n").alias("lang_n"))
        .filter(F.col("_docs") >= least_docs)
        .drop("_docs")
    )
    kept = write_table(
        counts.filter("term <> ''").join(by_term, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"),
        "kept-counts",
    )
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    groups = occurring.join(held, ["lang", "source"], "left").fillna(0, ["held"])
    langs = groups.groupBy("lang").agg(F.sum("held").alias("lang_held"), F.count(F.lit(1)).alias("sources"))
    terms = kept.groupBy("lang", "term").agg(F.lit(1).alias("_")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = langs.join(terms, "lang", "left").fillna(0, ["terms"])
    blocks = {
        "blocks": F.ceil(F.col("sources") / source_block),
        "term_blocks": F.greatest(F.ceil(F.col("terms") / term_block), F.lit(1)),
    }
    langs = langs.withColumns(blocks)
    groups = write_table(
        groups.join(langs, "lang").withColumns(
            {
                "block": F.pmod(F.xxhash64("source"), F.col("blocks")),
                "absent": probability(F.lit(0).cast("long"), F.col("held"), F.col("terms")),
            }
        ),
        "groups",
    )
    rated = kept.join(groups, ["lang", "source"]).withColumns(
        {
            "p": probability(F.col("n"), F.col("held"), F.col("terms")),
            "q": probability(F.col("lang_n"), F.col("lang_held"), F.col("terms")),
            "k": F.pmod(F.xxhash64("term"), F.col("term_blocks")),
        }
    )

    # the third axis: kept terms in each block, then every source's slice of it, empty or not
    per_block = rated.select("lang", "k", "term").distinct().groupBy("lang", "k").agg(F.count(F.lit(1)).alias("in_block"))
    whole = groups.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)))
    whole = whole.join(per_block, ["lang", "k"], "left").fillna(0, ["in_block"])
    keys = ["lang", "k", "source", "block", "term", "p", "terms"]
    marks = _cells(
        whole.withColumn("term", F.lit(None).cast("string")).withColumns({"p": F.col("absent"), "terms": F.col("in_block")}),
        F.col("blocks"), keys,
    )
    slices = _cells(rated.withColumn("terms", F.lit(0).cast("long")), F.col("blocks"), keys)
    partial = (
        marks.unionByName(slices)
        .groupBy("lang", "i", "j", "k")
        .applyInArrow(_cell_sums, "lang string, a string, b string, value long")
    )
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
        )
    )
    pairs = sums.select("lang", both.alias("_s"), "value").select("lang", "_s.source", "_s.item", "value")
    own = rated.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(order))
    ranked_terms = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        ranked_pairs.withColumn("part", F.lit("pair")).select(*columns)
        .unionByName(ranked_terms.withColumn("part", F.lit("term")).select(*columns))
    )
