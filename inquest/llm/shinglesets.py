"""Near copies by SimHash and by exact Jaccard similarity of word shingles.

Every set has a SimHash fingerprint of its text's shingles. Sets whose fingerprints lie within three
bits, found by the sharded trees of ``simhash.py``, are the first pairs; like all pairs they count as
links once their whole sets confirm them. What fingerprints so close do not show, most pairs of similarity
0.8 to 0.95, is found by the sets themselves:

Two sets of similarity 0.8 or more share one of their first ``n - ceil(0.8 n) + 1`` members in
any order that holds for all sets (prefix filter), so every such pair meets under a shared
member. The order is by hash, with members that a sample shows to be common put last; the sample
only decides how many pairs meet, never which links are found. Prefixes are stored, whole sets
are not: members that occur in one prefix are counted out before anything else is kept. A bounded table
of bits tells most of them where the prefixes are read, so that only members that several prefixes may
hold become rows, which carry sketches and may be dealt anew.

Sets that share a member form a list. A long list is dealt into blocks, and each pair of blocks is
a cell of its own, so no task gets a whole hot list and no pair meets twice. Pairs are ruled out
by their sizes, their places in the order and by sketches, which say for each bit whether an even
or odd number of members falls on it: sets differ in at least as many members as their sketches
differ in bits. A sketch of 256 bits travels with each list; the pairs it leaves are held to one
of at least two bits a member. What is left is confirmed on the whole sets, which are made
again from those texts alone.

Pairs meet in rounds. The first takes the pairs by fingerprint, neighbours by size in each cell and
every set with its cell's first. The next ones compare each set with the closest one of its list that is not yet in its
component, which joins large groups by about as many pairs as they have members. The last one
compares every pair that is not yet in one component, so no link is lost.

Members are 64-bit hashes of shingles. Null and empty texts have no words and form one class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from inquest.llm import simhash
from inquest.llm.common import (broadcast_within, bucketed, compact, cut_lineage, present, spool,
                                unused)
from inquest.llm.simhash import LOWER, components

COMMON = 1 << 18          # at most so many members are put last
SAMPLE, OFTEN = 16, 8     # one text in SAMPLE is sampled; OFTEN times there is common
LIST = 4096               # rows of a block of a list
PAIRS = 1 << 18           # pairs compared at once in a task
CLOSEST = 1               # rounds that compare each set with its closest open one
SKETCH = 256              # bits of the smallest sketch
TABLE = 21                # the table of shared members has at most 2^TABLE words of 64 bits
RADIUS = 3                # fingerprints that differ in so many bits are looked at first


def hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """The hashes of the shingles, repeats included; a shorter text is one shingle."""
    words = text.translate(LOWER).split()       # splits at ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths).tolist(), ends[shingle - 1:].tolist() or [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(first, last)),
                       dtype=np.uint64, count=len(last))


def members(text: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    return np.unique(hashes(text, shingle))


def sketch(members: np.ndarray) -> bytes:
    """At least two bits a member: whether an odd number of members falls on each."""
    bits = max(SKETCH, 1 << int(2 * len(members) - 1).bit_length()) if len(members) else SKETCH
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(wide: bytes, size: int) -> int:
    """A sketch as a whole number, folded to ``size`` bytes."""
    value, bits = int.from_bytes(wide, "little"), 8 * len(wide)
    while bits > 8 * size:
        bits //= 2
        value = (value ^ value >> bits) & ((1 << bits) - 1)
    return value


def apart(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return (folded(a, size) ^ folded(b, size)).bit_count()


def common_members(docs: DataFrame, shingle: int) -> np.ndarray:
    """Members that occur often in the sampled texts, as many of the commonest as fit a bound."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text in part.column(0).to_pylist():
                found = members(text.encode("utf-8", "replace"), shingle)
                yield pa.record_batch([pa.array(found.view(np.int64))], names=["m"])
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = spool(some.select(present(F.col("text")).alias("text")).mapInArrow(run, "m long")
                   .groupBy("m").count().filter(F.col("count") >= OFTEN))
    # the least count of which all members fit, from how many members have each count
    by_count = counts.groupBy(F.least("count", F.lit(1 << 16)).alias("c")).agg(
        F.count("*").alias("n")).collect()
    least, total = None, 0
    for c, n in sorted(map(tuple, by_count), reverse=True):
        total += n
        if total > COMMON:
            break
        least = c
    if least is None:
        return np.zeros(0, dtype=np.int64)
    late = counts.filter(F.col("count") >= least).select("m").toArrow()
    return np.sort(np.asarray(late.column("m"), dtype=np.int64))


def shingle_sets(docs: DataFrame, shingle: int, late: np.ndarray) -> DataFrame:
    """``doc_id, text_hash, key, n, prefix, wide, fp`` for every row; equal sets have equal keys."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, 1024):
                some = part.slice(start, 1024)
                keys, sizes, firsts, wide, fps = [], [], [], [], []
                for text in some.column(2).to_pylist():
                    every = hashes(text.encode("utf-8", "replace"), shingle)
                    fps.append(simhash.signed(simhash.majority(every)))
                    found = np.unique(every)
                    n = len(found)
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sizes.append(n)
                    wide.append(sketch(found))
                    whole = found.view(np.int64)
                    if len(late):
                        at = np.minimum(np.searchsorted(late, whole), len(late) - 1)
                        whole = whole[np.argsort(late[at] == whole, kind="stable")]
                    firsts.append(whole[:n - (4 * n + 4) // 5 + 1])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in firsts])])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                                 pa.array(np.concatenate(firsts)))
                yield pa.record_batch(
                    [some.column(0), some.column(1), pa.array(keys), pa.array(sizes, pa.int32()),
                     lists, pa.array(wide), pa.array(fps, pa.int64())],
                    names=["doc_id", "text_hash", "key", "n", "prefix", "wide", "fp"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("text_hash"),
                       present(F.col("text")).alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, key binary, n int, prefix array<long>, wide binary, fp long")


def bit_table(members: DataFrame) -> np.ndarray:
    """Bits of which ``member`` sets the one that its last bits name: some 16 a member, of a bounded number."""
    size = 1 << min(TABLE, (members.count() // 4).bit_length())
    word = F.shiftrightunsigned("member", 6).bitwiseAND(F.lit(size - 1))
    rows = members.groupBy(word.alias("word")).agg(F.bit_or(F.expr(
        "shiftleft(1L, CAST(member & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(size, dtype=np.uint64)
    table[np.asarray(rows.column("word"), dtype=np.int64)] = np.asarray(
        rows.column("bits"), dtype=np.int64).view(np.uint64)
    return table


def posted(sets: DataFrame, table: np.ndarray) -> DataFrame:
    """``id, n, at, member, s0 .. s3``: the places of the members whose bit is set, with the set's sketch
    folded to four numbers."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, 1024):
                ids, n, wide, prefix = part.slice(start, 1024).columns
                size = np.asarray(prefix.value_lengths(), dtype=np.int64)
                flat = np.asarray(prefix.flatten(), dtype=np.int64)
                member = flat.view(np.uint64)
                word = table[(member >> np.uint64(6)) & np.uint64(len(table) - 1)]
                kept = np.nonzero(word >> (member & np.uint64(63)) & np.uint64(1))[0]
                of = np.repeat(np.arange(len(size)), size)[kept]
                at = kept - (np.cumsum(size) - size)[of]
                small = [folded(w, SKETCH // 8).to_bytes(SKETCH // 8, "little") for w in wide.to_pylist()]
                words = np.frombuffer(b"".join(small), dtype=np.int64).reshape(-1, 4)[of]
                yield pa.record_batch([ids.take(pa.array(of)), n.take(pa.array(of)),
                                       pa.array(at.astype(np.int32)), pa.array(flat[kept]),
                                       *(pa.array(words[:, k]) for k in range(4))],
                                      names=["id", "n", "at", "member", "s0", "s1", "s2", "s3"])
    return sets.select("id", "n", "wide", "prefix").mapInArrow(
        run, "id long, n int, at int, member long, s0 long, s1 long, s2 long, s3 long")


def cells(sets: DataFrame) -> DataFrame:
    """``cell, id, n, at, salt, s0 .. s3``: the lists of members that several prefixes hold.

    In a cell of two blocks (two salts) rows of different blocks are to be compared, in a cell of
    one block all.
    """
    many = spool(sets.select(F.explode("prefix").alias("member")).groupBy("member")
                 .agg(F.count("*").alias("c")).filter("c > 1"))
    met = posted(sets, bit_table(many)).join(broadcast_within(many, 16), "member")
    blocks = F.ceil(F.col("c") / LIST).cast("int")
    salt = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda t: F.struct(
        F.least(salt, t).alias("low"), F.greatest(salt, t).alias("high")))
    dealt = met.select("member", "id", "n", "at", salt.alias("salt"), "s0", "s1", "s2", "s3",
                       F.explode(pairs).alias("p"))
    return dealt.select(F.xxhash64("member", "p.low", "p.high").alias("cell"), "id", "n", "at",
                        "salt", "s0", "s1", "s2", "s3")


def groups(parts: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows of a task sorted by their first column, in pieces of whole groups."""
    held: list[np.ndarray] | None = None
    for part in parts:
        rows = [np.asarray(c, dtype=np.int64) for c in part.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        last = len(rows[0]) - int(np.argmax(np.append(rows[0][::-1] != rows[0][-1], True)))
        if last:
            yield [x[:last] for x in rows]
        held = [x[last:] for x in rows]
    if held is not None and len(held[0]):
        yield held


def starts(cell: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.nonzero(np.diff(cell))[0] + 1, [len(cell)]])


def possible(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple:
    """Those pairs of rows whose sets can be similar if this is their first member, and how far
    their sketches are apart."""
    _, ids, n, at, salt, *bits = rows
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    rest = np.minimum(n[i] - at[i], n[j] - at[j])
    keep = (5 * small >= 4 * large) & (9 * rest >= 4 * (n[i] + n[j]))
    i, j = i[keep], j[keep]
    # as unsigned: a negative number's bits are counted without its sign
    far = sum((np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64)
               for x in bits[:4]), np.zeros(len(i), dtype=np.int64))
    keep = 9 * far <= n[i] + n[j]
    return i[keep], j[keep], far[keep]


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def near_pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in each cell, neighbours by size and all sets with the first; of two blocks
    only their first sets."""
    for rows in groups(parts):
        cell, ids, salt = rows[0], rows[1], rows[4]
        cuts = starts(cell)
        size = np.diff(cuts)
        mixed = np.minimum.reduceat(salt, cuts[:-1]) != np.maximum.reduceat(salt, cuts[:-1])
        head = np.repeat(cuts[:-1], size)
        here = np.arange(len(cell))
        rest = here[(head != here) & ~np.repeat(mixed, size)]
        other = [low + int(np.argmax(salt[low:high] != salt[low]))
                 for low, high in zip(cuts[:-1][mixed].tolist(), cuts[1:][mixed].tolist())]
        i = np.concatenate([rest - 1, head[rest], cuts[:-1][mixed]])
        j = np.concatenate([rest, rest, np.array(other, dtype=np.int64)])
        i, j, _ = possible(rows, i, j)
        yield distinct_pairs(ids[i], ids[j])


def open_pairs(one: bool):
    """Per task: the pairs of a cell whose sets are not in one component; of each set the closest
    one, or all."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(parts):
            cell, ids, n, salt, root = rows[0], rows[1], rows[2], rows[4], rows[-1]
            cuts = starts(cell)
            mixed = np.minimum.reduceat(salt, cuts[:-1]) != np.maximum.reduceat(salt, cuts[:-1])
            several = np.minimum.reduceat(root, cuts[:-1]) != np.maximum.reduceat(root, cuts[:-1])
            found_a, found_b, held = [], [], 0
            for k in np.nonzero(several)[0].tolist():
                low, high = int(cuts[k]), int(cuts[k + 1])
                step = max(1, PAIRS // (high - low))
                for x in range(low, high, step):
                    mine = np.arange(x, min(x + step, high))
                    # by size: none beyond 5/4 of the largest can be similar
                    end = low + int(np.searchsorted(n[low:high], 5 * n[mine[-1]] // 4, side="right"))
                    them = np.arange(x, end)
                    to = root[mine][:, None] != root[them][None, :]
                    if mixed[k]:
                        to &= salt[mine][:, None] != salt[them][None, :]
                    i, j = np.nonzero(to)
                    i, j = mine[i], them[j]
                    i, j, far = possible(rows, i[i < j], j[i < j])
                    if one:
                        order = np.lexsort((far, i))
                        i, first = np.unique(i[order], return_index=True)
                        j = j[order][first]
                    found_a.append(ids[i])
                    found_b.append(ids[j])
                    held += len(i)
                    if held > PAIRS:
                        yield distinct_pairs(np.concatenate(found_a), np.concatenate(found_b))
                        found_a, found_b, held = [], [], 0
            if found_a:
                yield distinct_pairs(np.concatenate(found_a), np.concatenate(found_b))
    return run


def close(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: pairs whose wide sketches allow a similarity of 0.8."""
    for part in parts:
        a, b, na, nb, wa, wb = (c.to_pylist() for c in part.columns)
        keep = [9 * apart(x, y) <= m + n for x, y, m, n in zip(wa, wb, na, nb)]
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"]).filter(pa.array(
            keep, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs whose sets have Jaccard similarity 0.8 or more."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    likely = compact(cut_lineage(one.join(broadcast_within(pairs, 16), "a").join(two, "b").select(
        "a", "b", "na", "nb", "wa", "wb").mapInArrow(close, "a long, b long")))
    ids = compact(cut_lineage(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    if ids.isEmpty():
        return likely
    found = spool(whole(ids))
    both = F.size(F.array_intersect("ma", "mb"))
    return (likely.join(found.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
            .join(found.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
            .filter(9 * both >= 4 * (F.size("ma") + F.size("mb"))).select("a", "b"))


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """``a, b``: pairs that join all sets whose SimHash fingerprints lie within the radius."""
    first = compact(cut_lineage(sets.groupBy("fp").agg(F.min("id").alias("of"))))
    known = broadcast_within(first, 16)
    same = sets.select("id", "fp").join(known, "fp").filter("id <> of").select(
        F.col("of").alias("a"), F.col("id").alias("b"))
    one, two = (known.select(F.col("fp").alias(c), F.col("of").alias(f"id_{c}")) for c in "ab")
    near = simhash.links(first, RADIUS).join(one, "a").join(two, "b")
    return same.unionByName(near.select(F.least("id_a", "id_b").alias("a"),
                                        F.greatest("id_a", "id_b").alias("b")))


def links(sets: DataFrame, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b``: pairs that join all sets that links of similarity 0.8 or more join.

    ``sets`` has ``id, n, prefix, wide, fp``; ``whole`` gives ``id, members`` for a table of ids.
    """
    shared = bucketed(cells(sets), "cell")
    known = spool(sets.select("id", "n", "wide"))
    found, at = None, 0
    meets = [near_pairs, *[open_pairs(True)] * CLOSEST, open_pairs(False)]
    # a window keeps the rows of a cell together and in order, without a shuffle of the buckets
    order = Window.partitionBy("cell").orderBy("n", "id")
    while at < len(meets):
        rooted = shared
        if found is not None:
            joined = components(found)
            rooted = shared.join(broadcast_within(joined, 16), shared["id"] == joined["node"],
                                 "left").select(*shared.columns,
                                                F.coalesce("root", "id").alias("root"))
        rooted = rooted.select(*shared.columns, F.row_number().over(order).alias("nth"),
                               *(["root"] if found is not None else []))
        pairs = rooted.mapInArrow(meets[at], "a long, b long")
        if found is None:
            pairs = pairs.unionByName(fingerprint_pairs(sets))
        pairs = compact(cut_lineage(pairs.distinct()))
        sure = compact(cut_lineage(confirmed(pairs, known, whole)))
        nothing = sure.isEmpty()
        # the components so far stand for the links that made them
        found = sure if found is None else sure.unionByName(
            joined.select(F.col("node").alias("a"), F.col("root").alias("b")))
        # a round of closest pairs that confirms nothing leaves the rest to the last round
        at = len(meets) - 1 if nothing and 0 < at < len(meets) - 1 else at + 1
    return found


def classes(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``doc_id, text_hash, class`` for every row of ``docs``."""
    late = common_members(docs, shingle)
    rows = spool(shingle_sets(docs, shingle, late)
                 .withColumn("id", F.monotonically_increasing_id()))
    keys = compact(cut_lineage(rows.groupBy("key").agg(F.min("id").alias("id"))))
    # the repeats are fewer than the sets: where they fit a broadcast no prefix travels
    again = compact(cut_lineage(rows.select("id").join(keys.select("id"), "id", "left_anti")))
    sets = rows.filter("n > 0").join(broadcast_within(again, 16), "id", "left_anti")
    sets = sets.select("id", "n", "prefix", "wide", "fp")

    def whole(ids: DataFrame) -> DataFrame:
        """The members of some sets, from a text that has them."""
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                found = [members(x.encode("utf-8", "replace"), shingle).view(np.int64)
                         for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(found, pa.list_(pa.int64()))],
                                      names=["id", "members"])
        wanted = compact(cut_lineage(rows.join(broadcast_within(ids, 16), "id", "left_semi").select(
            "id", F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("text_hash").alias("h"))))
        texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"),
                            F.xxhash64("text").alias("h"), present(F.col("text")).alias("text"))
        return (texts.join(broadcast_within(wanted, 32), ["d", "h"]).select("id", "text")
                .mapInArrow(run, "id long, members array<long>").dropDuplicates(["id"]))
    member = components(links(sets, whole))
    named = compact(cut_lineage(keys.join(member, keys["id"] == member["node"], "left").select(
        "key", F.coalesce("root", "id").alias("class"))))
    return rows.select("doc_id", "text_hash", "key").join(broadcast_within(named, 40), "key").select(
        "doc_id", "text_hash", "class")


def one_per_class(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents that stay: of each class the one with the smallest id, nulls last.

    If texts of a class share that id, the one with the smallest hash stays; of rows that repeat
    both, the smallest by its columns.
    """
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = compact(cut_lineage(classes(docs, shingle).groupBy("class").agg(
        F.min(ordered).alias("k")).select("k.doc_id", "k.text_hash")))
    return keep_rows(docs, kept)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``doc_id, text_hash`` of ``kept``."""
    names = docs.columns
    hashed, nth = unused(docs, "hash"), unused(docs, "nth")
    here = docs.withColumn(hashed, F.xxhash64("text"))
    stays = here.join(kept, here["doc_id"].eqNullSafe(kept["doc_id"])
                      & (here[hashed] == kept["text_hash"]), "left_semi")
    again = stays.groupBy("doc_id", hashed).agg(F.count("*").alias(nth)).filter(F.col(nth) > 1)
    if again.isEmpty():
        return stays.select(*names)
    order = Window.partitionBy("doc_id", hashed).orderBy(*[F.col(f"`{c}`") for c in names])
    return (stays.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
            .select(*[F.col(f"`{c}`") for c in names]))
