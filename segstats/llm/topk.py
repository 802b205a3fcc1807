"""Exact top-k inner products with multi-resolution segment statistics.

``|q - x|^2 = |q|^2 + |x|^2 - 2<q, x>``, and within a segment of n components
``<q, x> <= n (mean_q mean_x + dev_q dev_x)``, so segment means and deviations
bound the score (equivalently the distance) from one side. A task compares a
block of candidates with a block of queries coarse to fine, down to segments of
two components: pairs whose bound at some resolution is under the query's
current k-th score are left out, and survivors get their exact integer scores.
Blocks of queries are a written table that the tasks read one at a time;
candidates never move, and neither vectors nor ids pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.common import prepare_workers, write_table
from segstats.llm.token_files import file_system
from segstats.session import shared_dir

#: Queries in a block on average, candidates compared at once, components of candidates that a task holds.
QUERY_BLOCK, ROWS, HELD = 2048, 1024, 4 << 20
#: Segments at each resolution; a last one has segments of two components.
RESOLUTIONS = (1, 4, 16)
#: Share of pairs that may survive for scores to be worked out pair by pair.
SPARSE = 0.25
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, is_query), v being floor(scale * x) of each component; ids or vectors that are null, or hold null or
    non-finite components, take no part."""
    as_double = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(as_double, lambda x: F.floor(x * float(scale))).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )


def segment_stats(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, and the segments' lengths."""
    cuts = np.unique(np.linspace(0, v.shape[1], min(count, v.shape[1]) + 1).astype(int))
    parts = [v[:, a:b] for a, b in zip(cuts, cuts[1:])]
    means = np.stack([p.mean(axis=1) for p in parts], axis=1)
    return means, np.stack([p.std(axis=1) for p in parts], axis=1), np.diff(cuts).astype(float)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; whole numbers in doubles are exact below 2^53, else Python's integers, held to a long."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), "i8")
    if float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1] < 2.0**53:
        return (q.astype(float) @ x.astype(float).T).astype("i8")
    big = q.astype(object) @ x.astype(object).T
    return np.array([[min(max(s, LONG_MIN), LONG_MAX) for s in row] for row in big], "i8")


def resolutions(size: int) -> list[int]:
    """Segment counts for vectors of a length, coarse to fine."""
    return sorted({n for n in RESOLUTIONS if n < size // 2} | {max(1, size // 2)}) if size else []


class Best:
    """The k best candidates so far of each query of one vector length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.levels = [(n, *segment_stats(vectors.astype(float), n)) for n in resolutions(vectors.shape[1])]
        self.q = np.zeros(0, "i8")
        self.vec = np.zeros(0, "i8")
        self.score = np.zeros(0, "i8")
        self.floor = np.full(len(ids), LONG_MIN, "i8")  # the k-th score so far
        self.pairs = self.left_out = 0

    def survivors(self, x: np.ndarray) -> np.ndarray:
        """Which pairs (query, candidate) may still count, coarse to fine; a query without k candidates wants all."""
        alive = np.ones((len(self.ids), len(x)), bool)
        floor = self.floor[:, None].astype(float)
        wide = x.astype(float)
        for count, qm, qd, n in self.levels:
            at = np.flatnonzero(alive.any(axis=0))
            if not len(at) or (self.floor == LONG_MIN).all():
                break
            xm, xd, _ = segment_stats(wide[at], count)
            bound = (qm * n) @ xm.T + (qd * n) @ xd.T
            slack = 1e-9 * ((np.abs(qm) * n) @ np.abs(xm).T + (qd * n) @ xd.T) + 1e-6
            alive[:, at] &= (bound + slack >= floor) | (self.floor == LONG_MIN)[:, None]
        self.pairs += alive.size
        self.left_out += alive.size - int(alive.sum())
        return alive

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        alive = self.survivors(x) & (self.ids[:, None] != ids[None, :])
        if alive.mean() > SPARSE:
            scores = exact_scores(self.v, x)
            at, c = np.nonzero(alive & (scores >= self.floor[:, None]))
            found = scores[at, c]
        else:
            at, c = np.nonzero(alive)
            found = pair_scores(self.v, x, at, c)
            wanted = found >= self.floor[at]
            at, c, found = at[wanted], c[wanted], found[wanted]
        if not len(at):
            return
        q = np.concatenate([self.q, at])
        vec = np.concatenate([self.vec, ids[c]])
        score = np.concatenate([self.score, found])
        order = np.lexsort((vec, np.invert(score), q))  # invert: descending without overflow
        q, vec, score = q[order], vec[order], score[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        top = rank < self.k
        self.q, self.vec, self.score = q[top], vec[top], score[top]
        full = rank == self.k - 1
        self.floor[q[full]] = score[full]


def pair_scores(q: np.ndarray, x: np.ndarray, at: np.ndarray, c: np.ndarray, together: int = 1 << 14) -> np.ndarray:
    """Integer inner products of given pairs, by the rules of ``exact_scores``."""
    if not q.size or not x.size or not len(at):
        return np.zeros(len(at), "i8")
    small = float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1] < 2.0**53
    q, x = (q.astype(float), x.astype(float)) if small else (q.astype(object), x.astype(object))
    out = []
    for lo in range(0, len(at), together):
        products = (q[at[lo : lo + together]] * x[c[lo : lo + together]]).sum(axis=1)
        out.append(products.astype("i8") if small else np.array([min(max(s, LONG_MIN), LONG_MAX) for s in products], "i8"))
    return np.concatenate(out)


def _matrices(ids: list, vectors: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer matrices, one pair for each vector length."""
    sizes = np.array([len(v) for v in vectors])
    out = []
    for n in np.unique(sizes) if len(sizes) else []:
        at = np.flatnonzero(sizes == n)
        out.append((np.array([ids[i] for i in at], "i8"), np.array([vectors[i] for i in at], "i8").reshape(len(at), n)))
    return out


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows by integer inner product.

    Ties go to the smaller id; fewer candidates give fewer rows. A row with the
    query's id is the query itself; rows repeated under another id count one by
    one. Only vectors of equal length are compared. Scores beyond a long are
    held at its ends. Tables with no query, or no rows, give no rows. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    rows = write_table(quantised(vectors, is_query, id_col, vector_col, scale), "topk-vectors")
    queries = write_table(rows.filter("is_query").select("vec_id", "v").distinct(), "topk-queries")
    blocks = max(1, -(-queries.count() // query_block))
    number = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    folder = shared_dir(spark, "topk-blocks")
    queries.withColumn("block", number).repartition("block").write.partitionBy("block").parquet(folder)
    found = _search(rows, folder, blocks, k)
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _search(rows: DataFrame, folder: str, blocks: int, k: int) -> DataFrame:
    """(query_id, vector, vec_id, score): the k best of the candidates that a task holds at a time, for every query.

    ``vector`` tells queries of one id apart: block, vector length and place in
    the block. The folder has to be a URI that Arrow's file systems know.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = file_system(folder)

        def matches(ids: list, vectors: list) -> Iterator[pa.RecordBatch]:
            held = {v.shape[1]: (i, v) for i, v in _matrices(ids, vectors)}
            for block in range(blocks):
                path = f"{root}/block={block}"
                if store.get_file_info(path).type != fs.FileType.Directory:  # no query fell into it
                    continue
                table = pq.read_table(path, filesystem=store, columns=["vec_id", "v"], partitioning=None)
                for own, queries in _matrices(table.column("vec_id").to_pylist(), table.column("v").to_pylist()):
                    size = queries.shape[1]
                    if size not in held:
                        continue
                    best = Best(own, queries, k)
                    for lo in range(0, len(held[size][0]), ROWS):
                        best.add(*(part[lo : lo + ROWS] for part in held[size]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(best.ids[best.q]),
                            pa.array([f"{block}:{size}:{q}" for q in best.q.tolist()], pa.string()),
                            pa.array(best.vec),
                            pa.array(best.score),
                        ],
                        ["query_id", "vector", "vec_id", "score"],
                    )

        ids, vectors, size = [], [], 0
        for batch in batches:
            more = batch.column(1).to_pylist()
            ids += batch.column(0).to_pylist()
            vectors += more
            size += sum(map(len, more))
            if size >= HELD:
                yield from matches(ids, vectors)
                ids, vectors, size = [], [], 0
        yield from matches(ids, vectors)

    return rows.select("vec_id", "v").mapInArrow(search, "query_id long, vector string, vec_id long, score long")
