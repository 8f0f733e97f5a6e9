"""Exact top-k by inner product: score everything, narrow score histograms, filter.

For one bounded block of queries at a time the candidates are streamed past it. A pass counts
scores per query in equal-width bins; the bin that holds the k-th best value becomes the next
interval, until a bin is one score wide. The last pass keeps what is above that value, and
the smallest ids among what equals it. Nothing of the candidates is shuffled but the counts
of the highest bins and the k rows that win.

Defined results: vectors that are null, hold null or non-finite components, or have no id take
no part. A query's own id is no candidate for it. Repeated query ids count once (the smallest
vector); repeated candidates each count. Missing trailing components count as zero. Scores
beyond the long range are clipped to it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inquest.llm.common import cut_lineage

BINS = 256
CELLS = 1 << 24          # scores held at once in a task
LONG = np.iinfo(np.int64)


def whole(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as whole doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x)
                   | F.abs(x.cast("double")).isin(float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of doubles, cut or padded with zeros to ``width``."""
    lengths = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while sums stay below 2^53, else in whole numbers."""
    most = np.abs(left).sum(1).max(initial=0) * np.abs(right).max(initial=0)
    if most < 2.0 ** 24:
        return (left.astype(np.float32) @ right.astype(np.float32).T).astype(np.float64)
    if most < 2.0 ** 53:
        return left @ right.T
    exact = np.array([[int(x) for x in row] for row in left], dtype=object).reshape(left.shape)
    other = np.array([[int(x) for x in row] for row in right], dtype=object).reshape(right.shape)
    return np.clip(exact @ other.T, LONG.min, LONG.max)


class Block:
    """A bounded block of queries and, for each, the interval that holds its k-th score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bound: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.k = ids[order], vectors[order], k
        n = len(ids)
        self.low = np.array([-bound] * n, dtype=object)
        self.span = 2 * bound + 1                            # of each interval
        self.width = -(-self.span // BINS)                   # of one bin
        self.need = np.full(n, k)                            # still to be found in the interval
        self.all = np.zeros(n, dtype=bool)                   # fewer candidates than k

    def scores(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = products(vectors, self.vectors)
        own = np.zeros(found.shape, dtype=bool)
        at = np.searchsorted(self.ids, ids)
        at[at == len(self.ids)] = 0
        same = self.ids[at] == ids
        own[np.nonzero(same)[0], at[same]] = True
        return found, own

    def bins(self, found: np.ndarray) -> np.ndarray:
        """Each score's bin: -1 below its query's interval, ``BINS`` above it."""
        if found.dtype == object:
            at = found - self.low
            out = np.clip(at // self.width, -1, BINS).astype(np.int64)
        else:
            at = found - self.low.astype(np.float64)
            out = np.clip(np.floor(at / self.width), -1, BINS).astype(np.int64)
        out[at >= self.span] = BINS
        return out

    def narrow(self, counts: list) -> None:
        """Move each interval to the bin that holds the k-th score; ``counts``: query, bin, n."""
        grid = np.zeros((len(self.ids), BINS), dtype=np.int64)
        for q, b, n in counts:
            grid[q, b] += n
        above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1]    # in this bin and higher ones
        enough = above >= self.need[:, None]
        hit = enough.any(axis=1) & ~self.all
        self.all |= ~enough.any(axis=1)
        at = BINS - 1 - np.argmax(enough[:, ::-1], axis=1)
        beyond = np.where(at + 1 < BINS, above[np.arange(len(at)), np.minimum(at + 1, BINS - 1)], 0)
        self.need = np.where(hit, self.need - beyond, self.need)
        self.low = np.where(hit, self.low + at.astype(object) * self.width, self.low)
        self.span, self.width = self.width, -(-self.width // BINS)


def batches(parts: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple]:
    rows = max(256, CELLS // max(1, len(block.ids)))
    width = block.vectors.shape[1]
    for part in parts:
        for start in range(0, part.num_rows, rows):
            piece = part.slice(start, rows)
            ids = np.asarray(piece.column(0), dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            yield ids[order], matrix(piece.column(1), width)[order]


def histogram(block: Block):
    """Per task: how many scores of each query fall into its highest bins."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        counts = np.zeros(n * (BINS + 2), dtype=np.int64)
        base = np.arange(n) * (BINS + 2) + 1
        for ids, vectors in batches(parts, block):
            found, own = block.scores(ids, vectors)
            at = block.bins(found)
            at[own] = -1
            counts += np.bincount((at + base).ravel(), minlength=len(counts))
        grid = counts.reshape(n, BINS + 2)[:, 1:-1]
        above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1]
        # below a task's own k-th score no bin can hold the k-th of all
        q, b = np.nonzero((grid > 0) & (above - grid < block.need[:, None]))
        yield pa.record_batch([pa.array(q, pa.int32()), pa.array(b, pa.int32()),
                               pa.array(grid[q, b], pa.int64())], names=["q", "b", "n"])
    return run


def winners(block: Block):
    """The scores above each k-th value, and the smallest ids of those that equal it."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in batches(parts, block):
            found, own = block.scores(ids, vectors)
            kth = block.low if found.dtype == object else block.low.astype(np.float64)
            above = ((found > kth) | block.all) & ~own
            row, col = np.nonzero(above)
            tied_col, tied_row = np.nonzero(((found == kth) & ~block.all & ~own).T)
            first = np.searchsorted(tied_col, tied_col)
            kept = np.arange(len(tied_col)) - first < block.need[tied_col]
            row = np.concatenate([row, tied_row[kept]])
            col = np.concatenate([col, tied_col[kept]])
            yield pa.record_batch(
                [pa.array(block.ids[col]), pa.array(ids[row]),
                 pa.array([int(x) for x in found[row, col]], pa.int64())],
                names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64,
          id_col: str = "vec_id", vector_col: str = "embedding",
          block_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each row with ``is_query``.

    ``block_rows`` bounds the queries that are sent to the tasks at once.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    asked = cut_lineage(rows.filter("asks").groupBy("id").agg(F.min("v").alias("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = rows.agg(F.max(norm).alias("n")).first()["n"] or 0.0
    facts = asked.agg(F.count("*").alias("n"), F.max(norm).alias("norm"),
                      F.max(F.size("v")).alias("width")).first()
    bound = min(int(longest * (facts["norm"] or 0.0) * (1 + 1e-9)) + 1, LONG.max)
    parts = max(1, -(-2 * facts["n"] // block_rows)) if facts["n"] > block_rows else 1
    candidates = rows.select("id", "v")
    out = None
    for part in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()
        if mine.num_rows == 0:
            continue
        block = Block(np.asarray(mine.column("id"), dtype=np.int64),
                      matrix(mine.column("v").combine_chunks(), max(1, facts["width"])), k, bound)
        while block.span > 1:
            counts = (candidates.mapInArrow(histogram(block), "q int, b int, n long")
                      .groupBy("q", "b").agg(F.sum("n").alias("n")))
            block.narrow([tuple(r) for r in counts.collect()])
        best = candidates.mapInArrow(winners(block), "query_id long, vec_id long, score long")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
