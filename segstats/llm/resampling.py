"""Importance resampling towards a target distribution of hashed word n-grams.

Features are all runs of one to three consecutive words, hashed into buckets by
CRC-32. A task keeps an Aho-Corasick dictionary of the distinct words it has
met, bounded by delimiters, whose payloads lead to the word's CRC, the CRC
with a space in front, and its length. A scan of the texts emits payloads; the CRC of a run
is composed from its neighbours' payloads (the CRC of A + B is that of A shifted
by the length of B, xor that of B), so no run is ever built as a string. Both
passes, counting and scoring, read the same scan. Bucket counts of the source
and the target give each bucket's gain, and a document's weight is the sum of
its features' gains; drawing without replacement takes the highest weights
with Gumbel noise of the document's id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import fresh_name, numbered, prepare_workers, write_table

BUCKETS, LONGEST_RUN, SCALE = 10_000, 3, 1000
#: Bytes of text scanned at once; bytes of words in a worker's dictionary; words longer than this stay out of it.
SCAN_BYTES, DICTIONARY_BYTES, LONGEST_KEY = 1 << 20, 2 << 20, 64

#: Word characters are digits, letters and all beyond ASCII, A-Z lower-cased; every other byte is a delimiter.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_HIT = np.dtype([("end", "i8"), ("word", "i8")])


def _zero_byte() -> np.ndarray:
    """The (4, 256) table of a CRC-32 moved on by one zero byte."""
    c = np.arange(256, dtype="u4")
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype("u4")
    whole = np.arange(256, dtype="u4") << (8 * np.arange(4, dtype="u4"))[:, None]
    return (whole >> np.uint32(8)) ^ c[whole & 255]


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """CRCs ``c`` moved on by one table, or by a table each (tables: (4, 256) or (len(c), 4, 256))."""
    a, b = c & 255, (c >> np.uint32(8)) & 255
    d, e = (c >> np.uint32(16)) & 255, c >> np.uint32(24)
    return tables[0][a] ^ tables[1][b] ^ tables[2][d] ^ tables[3][e]


class Shifts:
    """Tables that move a CRC on by so many bytes: ``place(n)`` gives the row of ``rows`` for n bytes."""

    def __init__(self):
        self.powers = [_zero_byte()]
        self.places: dict[int, int] = {}
        self.rows = np.zeros((0, 4, 256), "u4")

    def place(self, n: int) -> int:
        if n not in self.places:
            table = np.arange(256, dtype="u4") << (8 * np.arange(4, dtype="u4"))[:, None]
            for k in range(n.bit_length()):
                while len(self.powers) <= k:
                    self.powers.append(_apply(self.powers[-1], self.powers[-1]))
                if n >> k & 1:
                    table = _apply(self.powers[k], table)
            self.places[n] = len(self.rows)
            self.rows = np.concatenate([self.rows, table[None]])
        return self.places[n]

    def shifted(self, c: np.ndarray, place: np.ndarray) -> np.ndarray:
        flat = self.rows.reshape(-1)
        base = place.astype("i8") << 10
        out = flat[base + (c & np.uint32(255))]
        for k in (1, 2, 3):
            out = out ^ flat[base + (k << 8) + ((c >> np.uint32(8 * k)) & np.uint32(255))]
        return out


class Dictionary:
    """A worker's words with their payloads, and the automaton that finds them between delimiters."""

    def __init__(self, room: int = DICTIONARY_BYTES):
        self.room = room
        self.shifts = Shifts()
        self._begin()

    def _begin(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.searched = 0  # words that the automaton finds
        self.words: dict[bytes, int] = {}
        self.size = 0
        self.crc, self.spaced, self.place = [np.zeros(0, t) for t in ("u4", "u4", "i4")]

    def _add(self, words: list[bytes]) -> None:
        """Give new words their payloads."""
        for w in words:
            self.words[w] = len(self.words)
            self.size += len(w) + 2
        self.crc = np.append(self.crc, np.array([zlib.crc32(w) for w in words], "u4"))
        self.spaced = np.append(self.spaced, np.array([zlib.crc32(b" " + w) for w in words], "u4"))
        self.place = np.append(self.place, np.array([self.shifts.place(len(w) + 1) for w in words], "i4"))

    def _search(self) -> None:
        """Make the automaton find all words; called when they have grown by half, so its cost stays in proportion."""
        for w, k in list(self.words.items())[self.searched :]:
            if len(w) <= LONGEST_KEY:
                self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.searched = len(self.words)

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The words of a folded text that begins and ends with a delimiter: where each begins, and its number."""
        if self.size > self.room:
            self._begin()
        inside = (np.frombuffer(text, "u1") != 32).view("i1")
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1) + 1, np.flatnonzero(turn == -1) + 1
        found = np.full(len(starts), -1, "i8")
        if self.searched and len(self.automaton):
            hits = np.fromiter(self.automaton.iter(text.decode("latin-1")), _HIT)
            if len(hits) == len(found):
                return starts, hits["word"]
            found[np.searchsorted(ends, hits["end"])] = hits["word"]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            spelt = [text[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist())]
            new = {w for w in spelt if w not in self.words}
            self._add(sorted(new))
            found[missing] = [self.words[w] for w in spelt]
            if len(self.words) > 1.5 * self.searched:
                self._search()
        return starts, found

    def runs(self, word: np.ndarray) -> list[np.ndarray]:
        """CRCs of the runs of 1, 2, ... words that end at each word; the first of each longer run are meaningless."""
        place, spaced = self.place[word], self.spaced[word]
        out = [self.crc[word]]
        for _ in range(LONGEST_RUN - 1):
            before = np.concatenate([np.zeros(1, "u4"), out[-1][:-1]])
            out.append(self.shifts.shifted(before, place) ^ spaced)
        return out


_DICTIONARIES: list[Dictionary] = []


def _dictionary() -> Dictionary:
    """This worker's dictionary."""
    if not _DICTIONARIES:
        _DICTIONARIES.append(Dictionary())
    return _DICTIONARIES[0]


def segments(texts: list[bytes | None], limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (place of the text, folded text) of about ``limit`` bytes; a longer text comes in parts, cut at
    delimiters, each but the last in a list of its own."""
    some, size = [], 0
    for k, text in enumerate(texts):
        folded = (text or b"").translate(_FOLD)
        at = 0
        if len(folded) > limit and some:
            yield some
            some, size = [], 0
        while len(folded) - at > limit:
            cut = folded.rfind(b" ", at + 1, at + limit)
            if cut < 0:
                cut = folded.find(b" ", at + limit)
            if cut < 0:
                break
            yield [(k, folded[at:cut])]
            at = cut
        some.append((k, folded[at:]))
        size += len(folded) - at
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def scanned(
    dictionary: Dictionary, texts: list[bytes | None], buckets: int, limit: int = SCAN_BYTES
) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """For each list of segments: the text each word belongs to; the buckets of the runs of 1, 2 and 3 words that end
    at it; and the words before it in its text, 2 at most. A run needs as many words before its last one.

    A later part of a text is scanned behind the last two words of the part before, so no run is lost.
    """
    last, carried = -1, []
    for some in segments(texts, limit):
        kept = carried if some[0][0] == last else []
        joined = b" " + b"".join(w + b" " for w in kept) + b" ".join(part for _, part in some) + b" "
        starts, word = dictionary.scan(joined)
        edges = np.cumsum([1 + sum(len(w) + 1 for w in kept)] + [len(part) + 1 for _, part in some])
        sizes = np.diff(np.searchsorted(starts, edges))
        owner = np.repeat([k for k, _ in some], sizes)
        before = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        before[: sizes[0]] += len(kept)
        runs = [(c[len(kept) :] % np.uint32(buckets)).astype("i8") for c in dictionary.runs(word)]
        yield owner, runs, np.minimum(before, LONGEST_RUN - 1)
        last, carried = some[-1][0], joined[starts[1 - LONGEST_RUN :].min(initial=len(joined)) :].split()


def bucket_counts(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of a table's whole texts; each task sends its own counts, one row a bucket."""
    prepare_workers(table.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, total = _dictionary(), np.zeros(buckets, "i8")
        for batch in batches:
            for _, runs, before in scanned(dictionary, batch.column(0).to_pylist(), buckets):
                for longer, bucket in enumerate(runs):
                    total += np.bincount(bucket[before >= longer], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    texts = table.select(F.col(text_col).cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain: floor(1000 ln of its smoothed share of the target over that of the source)."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    counts = counts.unionByName(every.select("bucket", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    summed = counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    held = {r["bucket"]: (r["s"], r["t"]) for r in summed.collect()}  # one row a bucket, whatever the tables hold
    s = np.array([held[b][0] for b in range(buckets)], float)
    t = np.array([held[b][1] for b in range(buckets)], float)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(SCALE * np.log(ratio)).astype("i8").tolist()


def with_weights(
    docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, out: str = "importance"
) -> tuple[DataFrame, str]:
    """``docs`` with a struct of n_words, n_features and weight, and that column's name.

    The source distribution is that of ``docs`` themselves, the target that of
    ``target``; both are counted over all rows and whole texts. Null and empty
    texts, and texts without a word, have no feature and weight 0; an empty
    target or an empty table counts as no feature. Repeated rows count one by
    one. All rows and columns stay; a clashing ``out`` gets underscores in front.
    """
    spark = docs.sparkSession
    source = write_table(bucket_counts(docs, text_col, buckets), "bucket-counts")
    gained = spark.sparkContext.broadcast(
        np.array(gains(source, bucket_counts(target, text_col, buckets), buckets), "i8")
    )
    name = fresh_name(out, docs.columns)

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weigh(texts: pa.Array) -> pa.Array:
        dictionary, gain = _dictionary(), gained.value
        words, features, weight = np.zeros((3, len(texts)), "i8")
        for owner, runs, before in scanned(dictionary, texts.to_pylist(), buckets):
            if not len(owner):
                continue
            gain_of = gain[runs[0]]
            for longer, bucket in enumerate(runs[1:], 1):
                gain_of = gain_of + np.where(before >= longer, gain[bucket], 0)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            who = owner[first]
            words[who] += np.diff(np.append(first, len(owner)))
            features[who] += np.add.reduceat(before + 1, first)
            weight[who] += np.add.reduceat(gain_of, first)
        return pa.StructArray.from_arrays(
            [pa.array(words), pa.array(features), pa.array(weight)], ["n_words", "n_features", "weight"]
        )

    return docs.withColumn(name, weigh(F.col(text_col).cast("string").cast("binary"))), name


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256 of ``seed:doc_id`` (a null id reads as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(
    weighted: DataFrame, importance: str, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id"
) -> DataFrame:
    """``weighted`` without the struct, with n_features, weight, score and rank (1, 2, ... of the drawn; else null).

    Of the documents with ``least_words`` words, ``percent`` in a hundred (rounded
    down) are drawn: the highest scores, ties to the smaller id (null first);
    rows equal in both are drawn in any order. All rows move once, so select
    the columns worth moving before. Columns of the four names give way.
    """
    names = ["n_features", "weight", "score", "rank"]
    own = [c for c in weighted.columns if c != importance and c.lower() not in names]
    may = fresh_name("_may", [*own, *names])
    part = F.col(importance)
    rows = weighted.select(
        *own,
        part["n_features"].alias("n_features"),
        part["weight"].alias("weight"),
        (part["weight"] + gumbel(F.col(id_col), seed)).cast("long").alias("score"),
        (part["n_words"] >= least_words).alias(may),
    )
    # written before it is ranked: finding the ranges reads the scores a second time
    scored = write_table(rows, "scored")
    order = [F.col(may).desc(), F.col("score").desc(), F.col(id_col).asc_nulls_first()]
    placed, _ = numbered(scored, order, "rank", "drawn")
    able = placed.agg(F.count_if(may)).first()[0]
    drawn = F.col(may) & (F.col("rank") < able * percent // 100)
    return placed.withColumn("rank", F.when(drawn, F.col("rank") + 1)).drop(may)
