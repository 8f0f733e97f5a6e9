"""SimHash near-duplicates, linked through sharded vantage-point trees.

A fingerprint sums the bits of its word shingles' hashes. Its bits are dealt to one band more than
the radius, a band's bits to blocks, and the distance to a vantage point is kept per block. A triangle
bound holds for each block: two fingerprints within the radius differ, over all blocks together, by no
more than the radius in their distances to the vantage point, so in one band at least they do not differ.
Distinct fingerprints are dealt to one shard for each band, by its distances, and visit no other. A shard
with too many rows is a branch of the tree: it is dealt again by finer blocks of its band, which makes no
more rows, and at last by bands of another dealing of all bits. In a leaf, the exact distance of every
remaining pair is counted, in blocks of bounded size. A large leaf reports a spanning forest of its links,
so a group of near copies costs as many rows as it has members and yet loses no link.

Classes are the connected components of all links, by alternating large-star and small-star
steps, each cut by a checkpoint.

Defined results: null and empty texts have no words and the fingerprint zero, which links like
any other. Repeated rows are each returned. Null ids are members of their class but never name
it, unless all are null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from inquest.llm.common import broadcast_within, cut_lineage, few, fitted, present, spool

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))   # A-Z only
LEAF_ROWS = 20_000        # a shard with more rows is split, up to BLOCKS' depth
BLOCKS = (2, 1, 1)        # bits of a block at each depth of the tree
FINER = (1,)              # depths that cut the bands of the depth before into finer blocks
PAIRS = 1 << 22           # pairs compared at once in a leaf


def fingerprint(text: bytes, shingle: int = 3, chunk: int = 1 << 16) -> int:
    """The SimHash of all shingles, repeats included; only ``chunk`` hashes are held at once."""
    words = text.translate(LOWER).split()       # splits at ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths).tolist(), ends[shingle - 1:].tolist()
    if not last:
        first, last = [0], [len(line)]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), len(last)
    for at in range(0, n, chunk):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(first[at:at + chunk],
                                                                 last[at:at + chunk])],
                          dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int("".join("1" if 2 * x > n else "0" for x in ones.tolist()), 2)


def majority(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """The SimHash of hashes, repeats included: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), chunk):
        some = hashes[at:at + chunk].astype(">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int("".join("1" if 2 * x > len(hashes) else "0" for x in ones.tolist()), 2)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` is the fingerprint as a signed long."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.array([fingerprint(x.encode("utf-8", "replace"), shingle)
                            for x in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([part.column(0), pa.array(fps.view(np.int64))],
                                  names=["doc_id", "fp"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       present(F.col(text_col)).alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def block_masks(depth: int, bands: int) -> list[list[int]]:
    """Which bits belong to each block of each band; another dealing of the bits where not finer."""
    bits = np.random.default_rng(depth - (depth in FINER)).permutation(64)
    return [[int(sum(1 << int(b) for b in part)) for part in np.array_split(
        band, max(1, len(band) // BLOCKS[depth]))] for band in np.array_split(bits, bands)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def deal(rows: DataFrame, vantage: int, depth: int, radius: int) -> DataFrame:
    """``shard, band, fp``: every fingerprint in a shard of each band, or in a finer one of its band.

    ``shard`` of the row before is kept as a part of the key.
    """
    key = [F.col("shard")] if "shard" in rows.columns else []
    from_vantage = F.col("fp").bitwiseXOR(F.lit(signed(vantage)))
    shards = F.array(*[
        F.xxhash64(*key, F.lit(band), *[F.bit_count(from_vantage.bitwiseAND(F.lit(signed(m))))
                                        for m in masks])
        for band, masks in enumerate(block_masks(depth, radius + 1))])
    if depth in FINER:
        return rows.select(F.get(shards, F.col("band")).alias("shard"), "band", "fp")
    return rows.select(F.posexplode(shards).alias("band", "shard"), "fp").select(
        "shard", "band", "fp")


def leaf_links(radius: int):
    """Per task: the links within each of its shards, as a spanning forest."""
    def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = np.arange(len(fp))
        step = max(1, PAIRS // len(fp))
        for at in range(0, len(fp), step):
            near = np.bitwise_count(fp[at:at + step][:, None] ^ fp[None, at:]) <= radius
            a, b = np.nonzero(near)
            keep = a < b
            a, b = a[keep] + at, b[keep] + at
            while len(a):                    # hook the larger root below the smaller, then flatten
                ra, rb = root[a], root[b]
                open_ = ra != rb
                if not open_.any():
                    break
                a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
                while not np.array_equal(up := root[root], root):
                    root = up
        low = np.nonzero(root != np.arange(len(fp)))[0]
        return fp[low], fp[root[low]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, fps = [], []
        for part in parts:
            shards.append(np.asarray(part.column(0), dtype=np.int64))
            fps.append(np.asarray(part.column(1), dtype=np.int64).view(np.uint64))
        if not shards:
            return
        shard, fp = map(np.concatenate, (shards, fps))
        order = np.argsort(shard, kind="stable")
        shard, fp = shard[order], fp[order]
        cuts = np.concatenate([[0], np.nonzero(np.diff(shard))[0] + 1, [len(shard)]])
        size = np.diff(cuts)
        out_a, out_b = [], []
        # small shards together: every pair
        small = np.nonzero((size > 1) & (size <= 64))[0]
        for n in np.unique(size[small]):
            starts = cuts[small[size[small] == n]]
            rows = max(1, PAIRS // int(n * n))
            for at in range(0, len(starts), rows):
                block = starts[at:at + rows, None] + np.arange(n)
                f = fp[block]
                near = np.bitwise_count(f[:, :, None] ^ f[:, None, :]) <= radius
                g, i, j = np.nonzero(near)
                keep = i < j
                out_a.append(f[g, i][keep])
                out_b.append(f[g, j][keep])
        for s in np.nonzero(size > 64)[0]:
            a, b = forest(fp[cuts[s]:cuts[s + 1]])
            out_a.append(a)
            out_b.append(b)
        if out_a:
            a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
    return run


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b``: links of distinct fingerprints ``fp`` that join all within ``radius``.

    Every chain of fingerprints within the radius is kept; pairs already joined inside a shard
    may be left out.
    """
    vantage = fps.agg(F.min_by("fp", F.xxhash64("fp")).alias("v")).first()["v"]
    none = fps.sparkSession.createDataFrame([], "a long, b long")
    if vantage is None:
        return none
    rows, leaves = deal(fps.select("fp"), vantage % (1 << 64), 0, radius), []
    for depth in range(1, len(BLOCKS)):
        heavy = cut_lineage(rows.groupBy("shard").agg(F.count("*").alias("n"))
                            .filter(F.col("n") > LEAF_ROWS).select("shard"))
        if heavy.isEmpty():
            break
        heavy = broadcast_within(heavy, 16)
        leaves.append(rows.join(heavy, "shard", "left_anti"))
        vantage = ~vantage if depth % 2 else vantage * 31
        rows = spool(deal(rows.join(heavy, "shard", "left_semi"), vantage % (1 << 64), depth, radius))
    leaves.append(rows)
    spark = fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = [x.select("shard", "fp").repartition(parts, "shard")
             .mapInArrow(leaf_links(radius), "a long, b long") for x in leaves]
    return reduce(DataFrame.unionByName, found)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of every node's component; nodes without edges lack.

    Large-star hangs a node's larger neighbours below its smallest one, small-star its smaller
    ones; both keep what is connected and end in stars. A round that changes nothing is the last. The
    pairs of a round lie in as many partitions as they need, or each of its shuffles would have the
    tasks of all shuffle partitions, whose events the driver holds.
    """
    def star(df: DataFrame, both: bool) -> DataFrame:
        if both:
            ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
            df = df.select(F.explode(ends).alias("e")).select("e.u", "e.v")
        low = df.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        joined = df.join(low, "u")
        if both:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The distinct pairs, stored, with their number and a sum that tells a change."""
        df = cut_lineage(df)
        fact = tuple(few(df).agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())
        return fitted(df, fact[0]), fact

    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").distinct()

    current, mark = settled(pairs(edges.select(F.greatest("a", "b").alias("u"),
                                               F.least("a", "b").alias("v"))))
    while True:
        # no step makes more than two rows of a pair, so each fits in as many partitions as the pairs
        large = fitted(star(current, True), mark[0])
        small = fitted(star(large, False), mark[0])
        current, fact = settled(fitted(pairs(small), mark[0]))
        if fact == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = fact


def classes(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    rows = spool(fingerprints(docs, shingle, id_col, text_col))
    groups = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = components(links(groups, radius))
    rooted = groups.join(member, groups["fp"] == member["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut_lineage(rooted.join(smallest, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_class(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The documents that stay: of each class the one with the smallest id.

    Of rows that repeat that id, one text stays (the smallest); its repeats go as well.
    """
    kept = cut_lineage(classes(docs, radius, shingle).filter(
        F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct())
    names = docs.columns
    match = docs["doc_id"].eqNullSafe(kept["doc_id"])
    stays = docs.join(kept, match, "left_semi")
    # ids are unique but for repeated rows, which a class keeps once
    again = kept.join(stays.groupBy("doc_id").count().filter("count > 1"), "doc_id", "left_semi")
    if again.isEmpty() and not kept.filter("doc_id IS NULL").head(1):
        return stays
    order = Window.partitionBy("doc_id").orderBy(*names)
    return (stays.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1")
            .select(*names))
