"""Hard negatives by Kronecker-packed products: many exact scores from one multiplication.

Candidates are packed once: the biased d-th components of up to ``PACK`` rows are the fields of
one wide whole number. For an anchor, one multiplication for each of its components and one
sum give all scores of a pack, each in its own field; the biases are then taken off again. A
field is wide enough for the largest sum that the components of the table allow, so fields
never run into each other and scores are exact.

A first scan finds each anchor's best rows of its own label (its positives), a second one, for
each positive, the best rows of other labels within the band below the positive's score. A task
keeps only the best few for each anchor, over all its packs; only those are shuffled. Anchors
come in bounded blocks, whose results are written before the next block starts.

Defined results: rows without an id or a label, and vectors that are null or hold null or
non-finite components, take no part. Anchors are rows: a repeated anchor row has repeated
results, and a copy of an anchor (any other row, its id may be the same) can be its positive.
Ties go to the smaller id. Missing trailing components count as zero, and components beyond
the longest anchor meet nothing. Components and scores beyond the long range are clipped to it. Anchors
without a positive, and positives without a negative in the band, have no rows. An empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inquest.llm.common import shared_folder, spool
from inquest.llm.topk import LONG, matrix, usable, whole

PACK = 1024              # rows of one pack
FOUND = "a int, p int, id long, score long"


def field_bytes(most: int, most_anchor: int, width: int) -> int:
    """Bytes of a field that holds any sum of ``width`` products of biased components."""
    bits = (4 * most * most_anchor * max(1, width)).bit_length() + 1
    return 4 if bits <= 32 else 8 if bits <= 63 else -(-bits // 8)


def packer(width: int, most: int, size: int):
    """Per task: rows of ``id, label, v`` as packs of fields, with each row's component sum."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, PACK):
                piece = part.slice(start, PACK)
                rows = matrix(piece.column(2), width)
                if size <= 8:
                    fields = rows.astype(np.int64) + most
                    sums = [int(x) for x in (fields - most).sum(1)]
                    packs = [np.ascontiguousarray(fields[:, d]).astype(f"<u{size}").tobytes()
                             for d in range(width)]
                else:
                    exact = [[int(x) for x in row] for row in rows]
                    sums = [sum(row) for row in exact]
                    packs = [b"".join((row[d] + most).to_bytes(size, "little") for row in exact)
                             for d in range(width)]
                yield pa.record_batch(
                    [pa.array([piece.column(0).to_pylist()], pa.list_(pa.int64())),
                     pa.array([piece.column(1).to_pylist()], pa.list_(pa.int64())),
                     pa.array([[str(s) for s in sums]], pa.list_(pa.string())),
                     pa.array([packs], pa.list_(pa.binary()))],
                    names=["ids", "labels", "sums", "packs"])
    return run


class Anchors:
    """A bounded block of anchors, with what the scans have found for them so far."""

    def __init__(self, rows: pa.Table, width: int, most: int, most_anchor: int, size: int):
        self.ids = np.asarray(rows.column("id"), dtype=np.int64)
        self.labels = np.asarray(rows.column("label"), dtype=np.int64)
        vectors = matrix(rows.column("v").combine_chunks(), width)
        self.whole = [[int(x) for x in row] for row in vectors]
        self.width, self.most, self.most_anchor, self.size = width, most, most_anchor, size
        self.biased = [[x + most_anchor for x in row] for row in self.whole]
        self.positives: list[list[int]] = [[] for _ in self.ids]     # scores

    def scores(self, sums: list[int], packs: list[bytes]) -> np.ndarray:
        """Exact scores of a pack: a row for each anchor, a column for each packed row."""
        wide = [int.from_bytes(p, "little") for p in packs]
        n, size, bias = len(sums), self.size, self.most_anchor
        out = np.empty((len(self.whole), n), dtype=np.int64)
        if size <= 8:
            drop = np.array(sums, dtype=np.int64) * bias
        for a, row in enumerate(self.whole):
            fields = sum(map(mul, self.biased[a], wide)).to_bytes(n * size, "little")
            # sum (x + bias)(c + most) holds most * sum x, bias * sum c and the product of both
            fixed = self.most * sum(row) + self.most * bias * self.width
            if size <= 8:
                out[a] = np.frombuffer(fields, f"<u{size}").astype(np.int64) - drop - fixed
            else:
                out[a] = [min(max(int.from_bytes(fields[i * size:(i + 1) * size], "little")
                                  - bias * sums[i] - fixed, LONG.min), LONG.max)
                          for i in range(n)]
        return out


class Best:
    """The ``k`` best ``(score, id)`` of each group so far, smaller ids first among equals."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group = np.empty(0, np.int64)
        self.score, self.id = self.group.copy(), self.group.copy()
        self.least = np.full(groups, LONG.min)           # a score below this cannot enter

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group = np.concatenate([self.group, group])
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, group))         # ~s falls as s grows, without overflow
        group, score, ids = group[order], score[order], ids[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.k
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        full = place == self.k - 1
        self.least[group[full]] = score[full]


def packs_of(parts: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple]:
    for part in parts:
        for i in range(part.num_rows):
            ids = np.asarray(part.column(0)[i].values, dtype=np.int64)
            labels = np.asarray(part.column(1)[i].values, dtype=np.int64)
            sums = [int(s) for s in part.column(2)[i].as_py()]
            yield ids, labels, anchors.scores(sums, part.column(3)[i].as_py())


def emitted(best: Best, ranks: int) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(best.group // ranks, pa.int32()), pa.array(best.group % ranks, pa.int32()),
         pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())],
        names=["a", "p", "id", "score"])


def positives(anchors: Anchors, k: int):
    """Per task: each anchor's best rows of its label, the anchor's own row still among them."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.ids), k + 1)
        for ids, labels, found in packs_of(parts, anchors):
            a, c = np.nonzero((labels[None, :] == anchors.labels[:, None])
                              & (found >= best.least[:, None]))
            best.add(a, found[a, c], ids[c])
        yield emitted(best, 1)
    return run


def negatives(anchors: Anchors, k: int, ranks: int, low: int):
    """Per task: for each positive, the best rows of other labels inside its band."""
    top = np.full((len(anchors.ids), ranks), LONG.min)
    bottom = np.full((len(anchors.ids), ranks), LONG.max)    # an empty band
    for a, scores in enumerate(anchors.positives):
        top[a, :len(scores)] = scores
        bottom[a, :len(scores)] = [min(-(-low * s // 100), LONG.max) for s in scores]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.ids) * ranks, k)
        for ids, labels, found in packs_of(parts, anchors):
            other = labels[None, :] != anchors.labels[:, None]
            for p in range(ranks):
                least = np.maximum(best.least[p::ranks], bottom[:, p])
                a, c = np.nonzero(other & (found >= least[:, None]) & (found <= top[:, p][:, None]))
                best.add(a * ranks + p, found[a, c], ids[c])
        yield emitted(best, ranks)
    return run


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "p").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, k_positives: int = 5,
                   k_negatives: int = 5, low: int = 80, scale: int = 256,
                   label: Column | None = None, id_col: str = "vec_id",
                   vector_col: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A negative scores at least ``low`` per cent of its positive and no more than it. ``label``
    is the class of a row, by default the column of that name; ``block_rows`` bounds the anchors
    that are sent to the tasks at once.
    """
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    rows = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & usable(F.col(vector_col))
                          ).select(F.col(id_col).cast("long").alias("id"),
                                   label.cast("long").alias("label"),
                                   whole(F.col(vector_col), scale).alias("v"),
                                   F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    facts = rows.agg(F.max(most).alias("most"), F.max(F.when(F.col("asks"), most)).alias("anchor"),
                     F.max(F.when(F.col("asks"), F.size("v"))).alias("width"),
                     F.count_if("asks").alias("n")).first()
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, "
              "positive_score long, negative_score long")
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    width, bias, bias_anchor = max(1, facts["width"]), int(facts["most"]), int(facts["anchor"])
    size = field_bytes(max(1, bias), max(1, bias_anchor), width)
    packed = spool(rows.select("id", "label", "v").mapInArrow(
        packer(width, bias, size),
        "ids array<long>, labels array<long>, sums array<string>, packs array<binary>"))
    asked = spool(rows.filter("asks").select("id", "label", "v"))
    parts = max(1, -(-2 * facts["n"] // block_rows)) if facts["n"] > block_rows else 1
    out = f"{shared_folder(spark)}/hard-{uuid.uuid4().hex}"

    def scan(run: Callable, k: int) -> DataFrame:
        return best_of(packed.mapInArrow(run, FOUND), k)
    for part in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()
        if mine.num_rows == 0:
            continue
        block = Anchors(mine, width, bias, bias_anchor, size)
        close: list[list[tuple]] = [[] for _ in block.ids]
        for r in scan(positives(block, k_positives), k_positives + 1).orderBy("a", "rank").collect():
            close[r.a].append((r.id, r.score))
        pairs = []
        for a, found in enumerate(close):
            # one copy of the anchor is the anchor itself: equal rows have equal scores
            own = (int(block.ids[a]), min(sum(x * x for x in block.whole[a]), LONG.max))
            if own in found:
                found.remove(own)
            del found[k_positives:]
            block.positives[a] = [s for _, s in found]
            pairs += [(a, p, int(block.ids[a]), i, s) for p, (i, s) in enumerate(found)]
        if not pairs:
            continue
        known = spark.createDataFrame(pairs, "a int, p int, anchor_id long, positive_id long, "
                                             "positive_score long")
        hard = scan(negatives(block, k_negatives, k_positives, low), k_negatives)
        hard.join(F.broadcast(known), ["a", "p"]).select(     # at most block_rows x k_positives
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(out)
    empty = spark.createDataFrame([], schema)
    empty.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
