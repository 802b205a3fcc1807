"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths (token counts) of frequent
pre-token chunks; tier two is each worker's own cache, which asks the library
for chunks in neither. Texts never leave their partition, and no pre-token is
a key of any exchange: which chunks are frequent is told by one bounded summary
a task, and summaries are merged in a tree until one is left. The table is only
a cache: what it holds changes no result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import fresh_name, prepare_workers, text_of, write_table
from segstats.llm.tokenization import CACHE_BYTES, LONGEST_CHUNK, encoder, entry_bytes, splits_on_white_space

#: Rows in the broadcast table (about 12 bytes each as sent), chunks in a summary, summaries that a task merges.
TABLE_WORDS, SUMMARY_WORDS, MERGED = 65_536, 65_536, 16

#: This worker's tiers by table: the lengths, and the bytes that tier two has added to them.
_LOOKUPS: dict[str, tuple[dict[str, int], list[int]]] = {}

_SUMMARY = "part long, words array<string>, counts array<long>"


def pruned(seen: Counter[str], size: int) -> Counter[str]:
    """At most ``size`` chunks of a Misra-Gries summary: every count less the first one that has no room."""
    if len(seen) <= size:
        return seen
    least = sorted(seen.values(), reverse=True)[size]
    return Counter({w: n - least for w, n in seen.items() if n > least})


def _summary(part: int, seen: Counter[str]) -> pa.RecordBatch:
    words, counts = list(seen), list(seen.values())
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
        ["part", "words", "counts"],
    )


def summaries(texts: DataFrame, summary_words: int = SUMMARY_WORDS, merged: int = MERGED) -> DataFrame:
    """One row (part, words, counts): a summary of the chunks of all texts, at most ``summary_words`` of them.

    Counts fall short by no more than one in ``summary_words`` of the chunks
    read, the more so the rarer a chunk; chunks of ``LONGEST_CHUNK`` characters
    are left out. Each task sends one summary; ``merged`` of them at a time are
    added and cut down again, by their number alone, until one is left.
    """

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from segstats.llm.tokenization import WordEncoder

        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                chunks = WordEncoder.chunks(text)
                if max(map(len, chunks)) >= LONGEST_CHUNK:
                    chunks = [w for w in chunks if len(w) < LONGEST_CHUNK]
                seen.update(chunks)
                if len(seen) > 2 * summary_words:
                    seen = pruned(seen, summary_words)
        seen.pop("", None)
        yield _summary(TaskContext.get().partitionId(), pruned(seen, summary_words))

    def merge(table: pa.Table) -> pa.Table:
        seen: Counter[str] = Counter()
        for words, counts in zip(table.column("words").to_pylist(), table.column("counts").to_pylist()):
            for w, n in zip(words, counts):
                seen[w] += n
            if len(seen) > 2 * summary_words:
                seen = pruned(seen, summary_words)
        return pa.Table.from_batches([_summary(table.column("part")[0].as_py() // merged, pruned(seen, summary_words))])

    found = write_table(texts.mapInArrow(sum_up, _SUMMARY), "chunk-summaries")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        found = found.groupBy(F.floor(F.col("part") / merged)).applyInArrow(merge, _SUMMARY)
        parts = -(-parts // merged)
    return found


def frequent_lengths(
    docs: DataFrame, tokenizer: str, text_col: str, table_words: int, summary_words: int = SUMMARY_WORDS
) -> tuple[str, bytes]:
    """The most frequent chunks of all documents, with their token counts.

    Returned compactly: the chunks joined by spaces, and one byte each (longer
    ones are left to tier two). The driver gets one summary, whatever the partitions.
    """
    one = summaries(docs.select(text_of(text_col).alias("text")), summary_words).first()
    counts = zip(one["words"], one["counts"]) if one else ()
    found = sorted((-n, w) for w, n in counts if n > 1)[:table_words]
    model = encoder(tokenizer)
    kept = [(w, model.count(w)) for _, w in found]
    kept = [(w, n) for w, n in kept if n < 256]
    return " ".join(w for w, _ in kept), bytes(n for _, n in kept)


def lookup(key: str, table, room: int) -> tuple[dict[str, int], list[int]]:
    """This worker's two tiers in one hash table, with tier two's bytes; begun anew when it has no more room."""
    known = _LOOKUPS.get(key)
    if known is None or known[1][0] > room:
        joined, sizes = table.value
        _LOOKUPS.clear()
        known = _LOOKUPS[key] = (dict(zip(joined.split(" "), sizes)) | {"": 0}, [0])
    return known


def with_token_counts(
    docs: DataFrame,
    tokenizer: str,
    text_col: str = "text",
    out: str = "n_tokens",
    table_words: int = TABLE_WORDS,
    summary_words: int = SUMMARY_WORDS,
) -> tuple[DataFrame, str]:
    """``docs`` with a column of whole-text token counts, and that column's name.

    Null text counts as empty (0 tokens). All other columns and rows, repeated
    ones too, stay as they are; if a column named ``out`` exists the new one
    gets underscores in front. An empty table stays empty.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    name = fresh_name(out, docs.columns)
    if splits_on_white_space(tokenizer):
        words, lengths = frequent_lengths(docs, tokenizer, text_col, table_words, summary_words)
    else:
        words, lengths = "", b""
    table = spark.sparkContext.broadcast((words, lengths))
    chunked, key = splits_on_white_space(tokenizer), uuid.uuid4().hex

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        model = encoder(tokenizer)
        if not chunked:
            return pa.array([model.count(t) for t in texts.to_pylist()], pa.int64())
        counts = []
        for text in texts.to_pylist():
            known, held = lookup(key, table, CACHE_BYTES)
            chunks = model.chunks(text)
            got = list(map(known.get, chunks))
            if None in got:
                missed = model.encode_words({w for w, n in zip(chunks, got) if n is None})
                lengths = {w: len(ids) // 4 for w, ids in missed.items()}
                got = [lengths[w] if n is None else n for w, n in zip(chunks, got)]
                for w, n in lengths.items():
                    if len(w) < LONGEST_CHUNK and held[0] <= CACHE_BYTES:
                        known[w] = n
                        held[0] += entry_bytes(w, 0)
            counts.append(sum(got))
        return pa.array(counts, pa.int64())

    return docs.withColumn(name, count(text_of(text_col))), name
