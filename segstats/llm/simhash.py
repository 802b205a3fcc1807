"""SimHash near-dedup by deletion-variant signatures.

Each text gets a 64-bit fingerprint over its word shingles; texts whose
fingerprints differ in at most ``max_distance`` bits are linked, and a group is
everything reachable by links. The fingerprint is cut into
``max_distance // 2 + 1`` segments, so linked fingerprints have one segment
that differs in at most one bit. Every distinct fingerprint is indexed under
each segment as it is and with each one bit of it left out; fingerprints that
meet under a key are compared in full. Only distinct fingerprints take part,
so copies cost nothing here, and a task keeps of its matches only those that
join two groups it has not joined before: a forest, never all pairs.

A key that holds more than ``block`` fingerprints is dealt out as pairs of
blocks, each pair compared by a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import fresh_name, prepare_workers, text_of, write_table

BITS = 64
#: Distinct fingerprints compared with each other in one go.
BLOCK = 4096


def _byte_lanes() -> np.ndarray:
    """For each byte, its eight bits in the eight byte lanes of a 64-bit word, lowest first."""
    bits = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


_LANES = _byte_lanes()


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` have each bit set, lowest bit first."""
    total = np.zeros(BITS, "i8")
    octets = hashes.astype("<u8").view("u1").reshape(-1, 8)
    for lo in range(0, len(octets), 255 * 64):  # a byte lane holds sums up to 255
        part = octets[lo : lo + 255 * 64]
        rows = -(-len(part) // 255)
        lanes = np.zeros((rows * 255, 8), "<u8")
        lanes[: len(part)] = _LANES[part]
        total += lanes.reshape(rows, 255, 8).sum(axis=1).view("u1").reshape(rows, BITS).sum(axis=0, dtype="i8")
    return total


def fingerprint(text: str, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, stops)], "<u8")
    over = set_bits(hashes) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(texts, shingle: int):
    """A column of signed 64-bit fingerprints."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in column.to_pylist()], "<u8").view("<i8"))

    return of(texts)


def segments(max_distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment: so few that some segment of a linked pair differs in at most one bit."""
    count = max_distance // 2 + 1
    cuts = [round(BITS * k / count) for k in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _segment(fp, lo: int, bits: int):
    value = F.shiftrightunsigned(fp, lo) if lo else fp
    return value if bits == BITS else value.bitwiseAND(F.lit((1 << bits) - 1))


def _variants(fp, max_distance: int) -> list:
    """The keys of a fingerprint: (tag, value). Tag 64 + k: segment k whole; tag j below 64: bit j left out."""
    keys = []
    for k, (lo, bits) in enumerate(segments(max_distance)):
        whole = _segment(fp, lo, bits)
        keys.append(F.struct(F.lit(BITS + k).alias("tag"), whole.alias("value")))
        if max_distance:
            for j in range(bits):
                bit = (1 << j) - (1 << BITS if j == BITS - 1 else 0)
                keys.append(F.struct(F.lit(lo + j).alias("tag"), whole.bitwiseAND(F.lit(~bit)).alias("value")))
    return keys


def _heavy_keys(distinct: DataFrame, max_distance: int, block: int) -> DataFrame:
    """(tag, value, blocks) of the keys that may hold more than ``block`` fingerprints.

    A key with a bit left out holds two whole segments' fingerprints, so the
    whole segments with more than half a block tell all of them.
    """
    segs = segments(max_distance)
    whole = distinct.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("k"), _segment(F.col("fp"), *s).alias("v")) for k, s in enumerate(segs)])
        ).alias("s")
    )
    heavy = whole.groupBy("s.k", "s.v").count().filter(F.col("count") * 2 > block)
    tags = [
        F.when(
            F.col("k") == k,
            F.array(
                F.struct(F.lit(BITS + k).alias("tag"), F.col("v").alias("value")),
                *[
                    F.struct(
                        F.lit(lo + j).alias("tag"),
                        F.col("v").bitwiseAND(F.lit(~((1 << j) - (1 << BITS if j == BITS - 1 else 0)))).alias("value"),
                    )
                    for j in range(bits if max_distance else 0)
                ],
            ),
        )
        for k, (lo, bits) in enumerate(segs)
    ]
    blocks = F.ceil(F.col("count") * 2 / block).cast("int")
    return (
        heavy.select(F.explode(F.coalesce(*tags)).alias("t"), blocks.alias("blocks"))
        .groupBy(F.col("t.tag").alias("tag"), F.col("t.value").alias("value"))
        .agg(F.max("blocks").alias("blocks"))
    )


class _Forest:
    """Union-find over fingerprints met so far; tells whether a link joins two groups."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _linked_in(rows: dict[str, np.ndarray], max_distance: int, forest: _Forest) -> list[tuple[int, int]]:
    """New links among whole groups of rows sorted by key."""
    fp = rows["fp"].view("u8")
    n = len(fp)
    same = np.ones(n - 1, bool) if n > 1 else np.zeros(0, bool)
    for c in ("tag", "value", "lo", "hi"):
        same &= rows[c][1:] == rows[c][:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    out = []
    at = np.flatnonzero(same)
    step = 1
    while len(at):
        x = fp[at] ^ fp[at + step]
        ok = np.bitwise_count(x) <= max_distance
        tag = rows["tag"][at]
        bit = np.minimum(tag, BITS - 1).astype("u8")
        ok &= (tag >= BITS) | ((x >> bit) & np.uint64(1)).astype(bool)  # equal segments meet under the whole one
        ok &= (rows["lo"][at] == rows["hi"][at]) | (rows["b"][at] != rows["b"][at + step])
        hit = at[ok]
        for a, b in zip(rows["fp"][hit].tolist(), rows["fp"][hit + step].tolist()):
            if forest.join(a, b):
                out.append((a, b))
        step += 1
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
    return out


def links(distinct: DataFrame, max_distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect whatever is connected among the distinct fingerprints ``fp``."""
    heavy = write_table(_heavy_keys(distinct, max_distance, block), "simhash-heavy")
    keyed = (
        distinct.select("fp", F.explode(F.array(*_variants(F.col("fp"), max_distance))).alias("t"))
        .select("fp", F.col("t.tag").alias("tag"), F.col("t.value").alias("value"))
        .join(heavy, ["tag", "value"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("b", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("tag", "value", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"), "b", "fp")
        .repartition("tag", "value", "lo", "hi")
        .sortWithinPartitions("tag", "value", "lo", "hi")
    )
    columns = ["tag", "value", "lo", "hi", "b", "fp"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        kept: dict[str, np.ndarray] | None = None

        def out(found):
            a = np.array(found, "i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for batch in batches:
            rows = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(columns)}
            if kept is not None:
                rows = {c: np.concatenate([kept[c], rows[c]]) for c in columns}
            n = len(rows["fp"])
            if not n:
                continue
            last = np.ones(n, bool)
            for c in ("tag", "value", "lo", "hi"):
                last &= rows[c] == rows[c][-1]
            cut = int(np.argmax(last))  # the last key's rows wait for the next batch
            kept = {c: rows[c][cut:] for c in columns}
            if cut and (found := _linked_in({c: rows[c][:cut] for c in columns}, max_distance, forest)):
                yield out(found)
        if kept is not None and (found := _linked_in(kept, max_distance, forest)):
            yield out(found)

    return keyed.mapInArrow(link, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each linked node can reach.

    Alternates two star steps: every node hands its larger neighbours, then
    its smaller ones, to the smallest it knows. Each round is written to the
    shared folder; it ends when a round changes nothing.
    """
    now = write_table(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(),
        "simhash-links",
    )
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(mark) or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(mark)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        now = write_table(
            joined.filter("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .distinct(),
            "simhash-links",
        )


def classes(marked: DataFrame, max_distance: int = 4, block: int = BLOCK) -> DataFrame:
    """``marked`` (doc_id, fp, ...; read more than once) with root (the class's smallest fingerprint) and component_id."""
    distinct = write_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = connected(links(distinct.select("fp"), max_distance, block))
    of_root = (
        roots.select("root").distinct().withColumn("node", F.col("root")).select("node", "root").union(roots)
    )
    linked = of_root.join(distinct.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("least_id").alias("class_id"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), "root", "class_id")
    named = distinct.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("component_id"),
    )
    return marked.join(write_table(named, "simhash-classes"), "fp")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fp (signed fingerprint), root, component_id, text_hash.

    ``component_id`` is the smallest non-null id reachable by links. Null and
    empty texts have fingerprint zero and are linked like any other; repeated
    rows share their class; an empty table gives no rows; other columns are not
    read. A text of any length is hashed whole.
    """
    prepare_workers(docs.sparkSession)
    text = text_of(text_col)
    marked = docs.select(F.col(id_col).alias("doc_id"), fingerprints(text, shingle).alias("fp"), F.xxhash64(text).alias("text_hash"))
    return classes(write_table(marked, "simhash-fingerprints"), max_distance)


def keep_one(
    docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest id (null ids last).

    Among rows equal in id and text any one stays. Columns are unchanged.
    """
    found = near_duplicates(docs, shingle, max_distance, id_col, text_col)
    rows = found.groupBy("root", "component_id", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    # A row knows its class's smallest id, so a large class is not gathered: few rows are left to choose among.
    smallest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = rows.filter(smallest)
    best = first.groupBy("root").agg(F.min("text_hash").alias("best"))
    chosen = first.join(best, "root").withColumn("keep", F.col("text_hash") == F.col("best")).drop("best")
    judged = chosen.unionByName(rows.filter(~smallest).withColumn("keep", F.lit(False)))
    judged = write_table(judged.select("doc_id", "text_hash", "n", "keep"), "simhash-kept")
    mark = fresh_name("_text_hash", docs.columns)
    hashed = docs.withColumn(mark, F.xxhash64(text_of(text_col)))

    def pick(how: str, frame: DataFrame, keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_k_id"), F.col("text_hash").alias("_k_hash"))
        return frame.join(keys, frame[id_col].eqNullSafe(keys["_k_id"]) & (frame[mark] == keys["_k_hash"]), how)

    stay = pick("left_anti", hashed, judged.filter("not keep"))
    repeated = judged.filter("keep and n > 1")
    single = pick("left_anti", stay, repeated)
    one_each = pick("left_semi", stay, repeated).dropDuplicates([id_col, mark])
    return single.union(one_each).drop(mark)
