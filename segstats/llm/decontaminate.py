"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark's word n-grams are counted over all documents; each item keeps
as seeds its rarest n-grams, so many that breaking them all, by whatever
replaced, inserted or left-out words, costs more than the threshold allows,
and all that are rare in the corpus. So a copy that scores at least the
threshold holds a seed whole. Where a document holds a seed, and n-grams of
the item in whose absence the threshold can still be reached, the passage
around it is aligned with the item; the score is that of the best local
alignment as a share of the item's own. Items are handled in blocks of bounded
size: the driver makes one at a time and writes it, and a task reads one at a
time, so neither memory nor the plan grows with the benchmark. Documents never move.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import fresh_name, prepare_workers, text_of
from segstats.llm.token_files import file_system
from segstats.session import shared_dir

#: Alignment scores of equal words, of different words, and of a word without partner.
MATCH, MISMATCH, GAP = 2, -1, -2
#: Share of an item's own score from which a passage is a copy of it; most words in a seed; share of documents up to
#: which an n-gram is rare; benchmark words in one block (about 100 bytes each).
THRESHOLD, SEED_WORDS, RARE, BLOCK_WORDS = 0.6, 3, 1e-4, 500_000

#: Marks that don't tell words apart.
_DROPPED = b".,!?;:\"'()[]*%$#&|"


def words_of(text: str) -> list[bytes]:
    """Lower-cased words between ASCII white space, as UTF-8 without the dropped marks."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _DROPPED).split()


def loss_allowed(words: int, threshold: float) -> float:
    """What edits may take from an item's own score before a copy falls under the threshold."""
    return (1 - threshold) * MATCH * words + 1e-9


def breaking_cost(positions: list[int], n: int) -> int:
    """The least loss of score by which no n-gram at these (ascending) positions of an item stays whole.

    A replaced word breaks the n n-grams over it, an inserted one the n - 1
    around it; a left-out word costs more than a replaced one, and a cut-off end
    breaks one n-gram a word, which an insertion does for no more unless n is 1.
    """
    replaced, inserted, reach = MATCH - MISMATCH, min(-GAP, MATCH), max(n - 1, 1)
    cost = [0] * (len(positions) + 1)  # from each position on
    after_replaced = after_inserted = len(positions)
    for k in range(len(positions) - 1, -1, -1):
        p = positions[k]
        while positions[after_replaced - 1] >= p + n:
            after_replaced -= 1
        while positions[after_inserted - 1] >= p + reach:
            after_inserted -= 1
        cost[k] = min(replaced + cost[after_replaced], inserted + cost[after_inserted])
    return cost[0]


@lru_cache(maxsize=10_000)
def seed_length(words: int, threshold: float) -> int:
    """The longest seeds of which every copy that reaches the threshold holds one whole."""
    for n in range(min(SEED_WORDS, words), 1, -1):
        if breaking_cost(list(range(words - n + 1)), n) > loss_allowed(words, threshold):
            return n
    return 1


@dataclass
class Block:
    """Some benchmark items: their words as numbers from 1, and which n-grams (each as one number) they hold."""

    ids: list
    items: list[np.ndarray]
    lengths: list[int]
    vocabulary: dict[bytes, int]
    codes: dict[int, np.ndarray]  # by n, sorted
    numbers: list[np.ndarray]  # of each item's n-grams in codes, by position

    def grams(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the n-gram) of the block's n-grams in a text."""
        base = len(self.vocabulary) + 1
        last = len(ids) - n + 1
        if last < 1 or not len(self.codes[n]):
            return np.zeros(0, int), np.zeros(0, int)
        known = ids > 0
        at = np.flatnonzero(np.logical_and.reduce([known[k : k + last] for k in range(n)]))
        code = np.zeros(len(at), "i8")
        for k in range(n):
            code = code * base + ids[at + k]
        place = np.minimum(np.searchsorted(self.codes[n], code), len(self.codes[n]) - 1)
        hit = self.codes[n][place] == code
        return at[hit], place[hit]

    def ids_of(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), "i8", len(words))


def make_block(items: list[tuple[object, list[bytes]]], threshold: float) -> Block:
    vocabulary: dict[bytes, int] = {}
    numbers = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], "i8") for _, words in items]
    lengths = [seed_length(len(w), threshold) for _, w in items]
    base = len(vocabulary) + 1
    grams = []
    for ids, n in zip(numbers, lengths):
        code = np.zeros(len(ids) - n + 1, "i8")
        for k in range(n):
            code = code * base + ids[k : k + len(code)]
        grams.append(code)
    codes = {n: np.unique(np.concatenate([g for g, m in zip(grams, lengths) if m == n])) for n in set(lengths)}
    places = [np.searchsorted(codes[n], g).astype("i4") for g, n in zip(grams, lengths)]
    return Block([i for i, _ in items], numbers, lengths, vocabulary, codes, places)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, threshold: float, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks, streamed through the driver one partition at a time."""
    held: list[tuple[object, list[bytes]]] = []
    size = 0
    for r in benchmark.select(F.col(id_col).alias("i"), text_of(text_col).alias("t")).toLocalIterator():
        words = words_of(r["t"])
        if words:
            held.append((r["i"], words))
            size += len(words)
        if size >= block_words:
            yield make_block(held, threshold)
            held, size = [], 0
    if held:
        yield make_block(held, threshold)


def document_frequencies(docs: DataFrame, block: Block, text_col: str) -> dict[int, np.ndarray]:
    """In how many documents each of the block's n-grams occurs: counted in the tasks, one sum per n-gram."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        totals = {n: np.zeros(len(c), "i8") for n, c in block.codes.items()}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = block.ids_of(text)
                for n, total in totals.items():
                    total[np.unique(block.grams(ids, n)[1])] += 1
        for n, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(at), pa.int32()), pa.array(at), pa.array(total[at])], ["n", "gram", "docs"]
            )

    rows = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "n int, gram long, docs long")
    out = {n: np.zeros(len(c), "i8") for n, c in block.codes.items()}
    for r in rows.groupBy("n", "gram").agg(F.sum("docs").alias("docs")).collect():  # at most the block's n-grams
        out[r["n"]][r["gram"]] = r["docs"]
    shared.destroy()
    return out


def choose_seeds(block: Block, frequency: dict[int, np.ndarray], rows: int, threshold: float, rare: float) -> dict[int, list]:
    """By n, for each n-gram, the (item, position) pairs for which it is a seed."""
    chosen: dict[int, list] = {n: [[] for _ in c] for n, c in block.codes.items()}
    for i, (ids, n, grams) in enumerate(zip(block.items, block.lengths, block.numbers)):
        cost = frequency[n][grams]
        order = np.argsort(cost, kind="stable")
        allowed = loss_allowed(len(ids), threshold)
        low, high = 1, len(order)  # the fewest of the rarest that can't all be broken
        while low < high:
            middle = (low + high) // 2
            if breaking_cost(np.sort(order[:middle]).tolist(), n) > allowed:
                high = middle
            else:
                low = middle + 1
        for p in order[: max(low, int((cost <= rare * rows).sum()))].tolist():
            chosen[n][grams[p]].append((i, p))
    return chosen


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Smith-Waterman score of the best local alignment of two word sequences; 0 stands for a word of no item."""
    steps = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, "i8")
    best = 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps  # gaps in the item, from any place to the left
        best = max(best, int(row.max()))
    return best


class Matcher:
    """Finds a block's items in texts."""

    def __init__(self, block: Block, seeds: dict[int, list], threshold: float):
        self.block, self.seeds, self.threshold = block, seeds, threshold
        self.known: dict[tuple[int, bytes], int] = {}

    def find(self, text: str) -> list[tuple[object, float]]:
        """(item id, score) of the items of which the text holds a copy."""
        block = self.block
        ids = block.ids_of(text)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        held = {n: block.grams(ids, n) for n in block.codes}
        for n, grams in held.items():
            for at, gram in zip(*(x.tolist() for x in grams)):
                for i, p in self.seeds[n][gram]:
                    size = len(block.items[i])
                    slack = int(loss_allowed(size, self.threshold) / -GAP) + 1  # words that gaps may shift
                    spans[i].append((max(0, at - p - slack), min(len(ids), at - p + size + slack)))
        out = []
        for i, found in spans.items():
            full = MATCH * len(block.items[i])
            passages = [(a, b) for a, b in merged(found) if self._may_hold(i, *held[block.lengths[i]], a, b)]
            best = max((self._align(i, ids[a:b]) for a, b in passages), default=0)
            if best >= self.threshold * full:
                out.append((block.ids[i], best / full))
        return out

    def _may_hold(self, i: int, at: np.ndarray, grams: np.ndarray, a: int, b: int) -> bool:
        """Whether the item's n-grams that words a to b don't hold can be missing from a copy."""
        block, n = self.block, self.block.lengths[i]
        inside = grams[np.searchsorted(at, a) : np.searchsorted(at, b - n, side="right")]
        missing = np.flatnonzero(~np.isin(block.numbers[i], inside)).tolist()
        return breaking_cost(missing, n) <= loss_allowed(len(block.items[i]), self.threshold)

    def _align(self, i: int, passage: np.ndarray) -> int:
        key = (i, passage.tobytes())
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[key] = align(self.block.items[i], passage)
        return self.known[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union as disjoint spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    out: str = "matches",
    threshold: float = THRESHOLD,
    rare: float = RARE,
    block_words: int = BLOCK_WORDS,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, str]:
    """``docs`` with the benchmark items each holds, array<struct<item_id, score>>, and that column's name.

    Words are lower-cased and compared without common marks. Null or empty
    texts, on either side, match nothing; items of few words are matched by
    their few words; repeated items are reported each; very long texts are read
    whole. Rows and other columns stay; a clashing ``out`` gets underscores in
    front. Empty tables give empty results or empty arrays.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    name = fresh_name(out, docs.columns)
    kind = benchmark.schema[item_id_col].dataType.simpleString()
    shape = f"array<struct<item_id:{kind},score:double>>"
    rows = docs.count()
    folder = shared_dir(spark, "benchmark-blocks")
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    blocks = 0
    for block in blocks_of(benchmark, item_id_col, item_text_col, threshold, block_words):
        seeds = choose_seeds(block, document_frequencies(docs, block, text_col), rows, threshold, rare)
        with store.open_output_stream(f"{root}/{blocks}") as f:
            f.write(pickle.dumps((block, seeds, threshold)))
        blocks += 1
    found = _finder(folder, blocks)(text_of(text_col)) if blocks else F.array()
    return docs.withColumn(name, found.cast(shape)), name


#: The block that this worker has read last.
_READ: dict[tuple[str, int], Matcher] = {}


def _matcher(folder: str, number: int) -> Matcher:
    """A block's matcher, read from its file; a worker holds one block, however many there are."""
    if (folder, number) not in _READ:
        _READ.clear()
        store, root = file_system(folder)
        with store.open_input_stream(f"{root}/{number}") as f:
            _READ[folder, number] = Matcher(*pickle.loads(f.read()))
    return _READ[folder, number]


def _finder(folder: str, blocks: int):
    @F.arrow_udf("array<struct<item_id:string,score:double>>")
    def find(column: pa.Array) -> pa.Array:
        from segstats.llm.decontaminate import _matcher

        texts = column.to_pylist()
        found: list[list[dict]] = [[] for _ in texts]
        for number in range(blocks):
            matcher = _matcher(folder, number)
            for text, own in zip(texts, found):
                own += [{"item_id": None if i is None else str(i), "score": s} for i, s in matcher.find(text)]
        return pa.array(found, pa.list_(pa.struct([("item_id", pa.string()), ("score", pa.float64())])))

    return find
