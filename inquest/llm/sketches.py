"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in columns only.

A text is cut into paragraphs (lines, and the sentences within a line). Each distinct paragraph
digest is added to three cells of a sketch, one in each third: a count, the digests' XOR and
their checks' XOR. Two versions' sketches of equal size subtract cell by cell; what they share
cancels. Peeling then takes out cells that hold a single digest, again and again, which recovers
the digests that differ. If cells remain, both sketches are built again with ``GROWTH`` times
the cells. Only cells that hold something are rows, and the digests are stored in buckets by
document, so sketching, subtracting and peeling shuffle nothing.

The fingerprint is the smallest sketch, written out in hexadecimal. Likeness of two versions is
the number of shared digests over that of all digests, from the sizes and the difference.

Defined results: a null text is the empty text, whose only paragraph is empty. Documents follow
each other by descending id, null ids after all others; equal ids follow by a hash of the text,
so repeated rows are each other's next documents. A single document is its own next. An empty
table gives an empty result. Should no size peel (equal checks), the difference is counted from
the digests themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inquest.llm.common import bucketed, cut_lineage, present

CUT = r"\n| (?<=[.!?] )"
CELLS, GROWTH, SIZES = 24, 16, 5      # cells at first, times more on failure, sizes tried
TURNS = 4                             # times each third is peeled at one size
DOC = ["r"]                           # the number of a row of the table
PAIR = [*DOC, "pair"]                 # 1: text and edited text, 2: text and next text


def check(key: Column) -> Column:
    return F.xxhash64(F.lit(7), key)


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, CUT), lambda p: F.xxhash64(p)))


def place(key: Column, third: int, j: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(j), key), F.lit(third)) + third * j).cast("int")


def summed(rows: DataFrame, *by: str) -> DataFrame:
    """Cells that hold something, from parts of them."""
    return rows.groupBy(*by, "cell").agg(
        F.sum("n").alias("n"), F.bit_xor("key").alias("key"),
        F.bit_xor("sum").alias("sum")).filter("n <> 0 OR key <> 0 OR sum <> 0")


def sketches(versions: DataFrame, cells: int) -> DataFrame:
    """The cells of each version; ``versions`` has ``r, v, digests``."""
    third = cells // 3
    key = F.col("key")
    items = versions.select(*DOC, "v", F.explode("digests").alias("key"))
    placed = items.select(*DOC, "v", "key", check(key).alias("sum"), F.explode(
        F.array(*[place(key, third, j) for j in range(3)])).alias("cell"))
    return summed(placed.withColumn("n", F.lit(1)), *DOC, "v")


def subtracted(cells: DataFrame) -> DataFrame:
    """The text's sketch less that of the edited text (pair 1) and of the next text (pair 2)."""
    v = F.col("v")
    sides = F.when(v == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(v))
    signed = F.when(v == 0, F.col("n")).otherwise(-F.col("n"))
    return summed(cells.select(*DOC, F.explode(sides).alias("pair"), "cell", signed.alias("n"),
                               "key", "sum"), *PAIR)


def peeled(cells: DataFrame, size: int) -> DataFrame:
    """``r, pair, found, stuck``: digests recovered from a difference, and cells left.

    The thirds take turns. Within one, a digest has a single cell, so each that is alone in its
    cell is found once; it leaves its other two cells, and cell -1 counts it.
    """
    third = size // 3
    for turn in range(3 * TURNS):
        j = turn % 3
        key, n = F.col("key"), F.col("n")
        alone = ((F.col("cell") >= third * j) & (F.col("cell") < third * (j + 1))
                 & (F.abs(n) == 1) & (F.col("sum") == check(key)))

        def part(cell: Column, n: Column, key: Column, total: Column) -> Column:
            return F.struct(cell.alias("cell"), n.cast("long").alias("n"), key.alias("key"),
                            total.alias("sum"))
        zero = F.lit(0).cast("long")
        gone = [part(place(key, third, i), -n, key, F.col("sum")) for i in range(3) if i != j]
        kept = F.array(part(F.col("cell"), n, key, F.col("sum")))
        moves = F.when(alone, F.array(part(F.lit(-1), F.lit(1), zero, zero), *gone)).otherwise(kept)
        cells = summed(cells.select(*PAIR, F.explode(moves).alias("m")).select(*PAIR, "m.*"), *PAIR)
    mark = F.col("cell") == -1
    return cells.groupBy(*PAIR).agg(
        F.coalesce(F.sum(F.when(mark, F.col("n"))), F.lit(0)).alias("found"),
        F.count(F.when(~mark, 1)).alias("stuck"))


def by_row(pairs: DataFrame) -> DataFrame:
    """One row per document: what was found of each pair, null where cells were left."""
    value = F.when(F.col("stuck") == 0, F.col("found")).otherwise(-1)
    return pairs.groupBy(*DOC).agg(*[
        F.coalesce(F.max(F.when(F.col("pair") == p, value)), F.lit(0)).alias(f"d{p}")
        for p in (1, 2)])


def versions(rows: DataFrame, columns: dict[int, str]) -> DataFrame:
    """``r, v, digests`` from one row per document."""
    return rows.select(*DOC, F.explode(F.array(*[
        F.struct(F.lit(v).alias("v"), F.col(c).alias("digests"))
        for v, c in columns.items()])).alias("x")).select(*DOC, "x.v", "x.digests")


def differences(rows: DataFrame) -> DataFrame:
    """``r, d1, d2``: digests not shared, or -1, and ``fp0, fp1``, the smallest sketches' bytes.

    ``rows`` is bucketed by ``r`` and has ``a, e, b``.
    """
    first = sketches(versions(rows, {0: "a", 1: "e", 2: "b"}), CELLS)

    def hexed(x: Column, n: int) -> Column:
        return F.lpad(F.hex(x), n, "0")
    cell = F.concat(hexed(F.col("cell"), 2), hexed(F.col("n"), 4), hexed(F.col("key"), 16),
                    hexed(F.col("sum").bitwiseAND(F.lit(0xFFFFFFFF)), 8))
    lists = [F.unhex(F.array_join(F.sort_array(F.collect_list(F.when(F.col("v") == v, cell))), ""))
             .alias(f"fp{v}") for v in (0, 1)]
    written = first.filter("v < 2").groupBy(*DOC).agg(*lists)
    done = cut_lineage(rows.select(*DOC).join(by_row(peeled(subtracted(first), CELLS)), DOC, "left")
                       .na.fill(0, ["d1", "d2"]))
    out, size = done.filter("d1 >= 0 AND d2 >= 0"), CELLS
    for _ in range(SIZES - 1):
        left = done.filter("d1 < 0 OR d2 < 0").select(
            *DOC, F.col("d1").alias("o1"), F.col("d2").alias("o2"))
        if left.isEmpty():
            return written.join(out, DOC)
        size *= GROWTH
        # a pair that was peeled already needs no sketch of its other version
        part = versions(rows.join(left, DOC).withColumn("e", F.when(F.col("o1") < 0, F.col("e")))
                        .withColumn("b", F.when(F.col("o2") < 0, F.col("b"))),
                        {0: "a", 1: "e", 2: "b"})
        found = by_row(peeled(subtracted(sketches(part, size)), size))
        done = cut_lineage(left.join(found, DOC, "left").select(*DOC, *[
            F.when(F.col(f"o{p}") < 0, F.coalesce(f"d{p}", F.lit(0)))
            .otherwise(F.col(f"o{p}")).alias(f"d{p}") for p in (1, 2)]))
        out = out.unionByName(done.filter("d1 >= 0 AND d2 >= 0"))
    return written.join(out.unionByName(done.filter("d1 < 0 OR d2 < 0")), DOC)


def likeness(left: Column, right: Column, apart: Column) -> Column:
    both = F.size(left) + F.size(right)
    return (both - apart) / (both + apart)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              ranges: int = 512) -> DataFrame:
    """``doc_id, text, next``: every text with that of the next document, ids descending.

    Ids are cut into ranges whose upper ends are ids themselves; a copy of each end's rows goes
    to the range above, where it follows the smallest id. Texts are shuffled once.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       present(F.col(text_col)).alias("text"), order.alias("o"))
    ends = rows.agg(F.percentile_approx("o", [i / ranges for i in range(1, ranges)], 10 * ranges)
                    .alias("q"), F.max("o").alias("top")).first()
    top = ends["top"] if ends["top"] is not None else 0
    bounds = sorted({*(ends["q"] or []), top})
    cut = F.lit(bounds).cast("array<bigint>")
    place = F.size(F.filter(cut, lambda b: b < F.col("o")))
    above = F.when(F.array_contains(cut, F.col("o")), F.pmod(place + 1, F.lit(len(bounds))))
    copies = F.filter(F.array(F.struct(place.alias("range"), F.lit(False).alias("copy")),
                              F.struct(above.alias("range"), F.lit(True).alias("copy"))),
                      lambda c: c["range"].isNotNull())
    dealt = rows.select("doc_id", "text", "o", F.explode(copies).alias("c"))
    dealt = dealt.select("doc_id", "text", "o", "c.range", "c.copy")
    down = Window.partitionBy("range").orderBy("copy", F.desc("o"), F.xxhash64("text"))
    return (dealt.withColumn("next", F.lead("text").over(down)).filter(~F.col("copy"))
            .select("doc_id", "text", "next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as
    many (or all) of the next document.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half),
                      F.substring("next", F.lit(1), half))
    rows = with_next(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("r"), "doc_id",
        n.cast("long").alias("n_chars"), edited.alias("edited"),
        digests(F.col("text")).alias("a"), digests(F.col("next")).alias("b"))
    rows = bucketed(rows.select(*DOC, "doc_id", "n_chars",
                                F.sha2("edited", 256).alias("edited_sha256"), "a", "b",
                                digests(F.col("edited")).alias("e")), "r")
    found = rows.join(differences(rows), DOC)

    def plain(c: str) -> Column:
        return F.size(F.array_except("a", c)) + F.size(F.array_except(c, "a"))
    apart = [F.when(F.col(f"d{p}") < 0, plain(c)).otherwise(F.col(f"d{p}")).alias(f"apart{p}")
             for p, c in ((1, "e"), (2, "b"))]
    return found.select("*", *apart).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp0")).alias("fingerprint"),
        F.lower(F.hex("fp1")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), F.col("apart1")).alias("near_edited"),
        likeness(F.col("a"), F.col("b"), F.col("apart2")).alias("near_next"),
        F.size("a").alias("n_paragraphs"))
