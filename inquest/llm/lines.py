"""Line dedup: repeated runs of lines are found by prefix doubling, later copies are deleted.

The corpus is one sequence of line ids, documents in order of their ids. Positions whose runs of
2^k lines are equal form a class, named by its first position; the classes of 2^(k+1) lines come
from the pairs of names 2^k lines apart, as in the construction of a suffix array. Classes of
one member drop out, so each round works on fewer positions, and the rounds end when no run
repeats. The classes of a round are the intervals of suffixes whose common prefix has at least
2^k lines; two overlapping ones give the class of any length between. Runs stay in a document.

A line is deleted when an earlier copy exists of some run that holds it and is substantial: it
has a line of at least ``min_words`` words, or at least four lines. The first copy stays.

Defined results: lines end at a line feed; a null text stays null, an empty one has one empty
line. Rows that repeat id and text are one document and share its fate. Documents with equal ids
are ordered by a hash of their texts; null ids come first. A document that loses all
lines keeps an empty text. All other columns are passed on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from inquest.llm.common import WORD, broadcast_within, cut_lineage, present, spool, unused

AT = ["o", "h", "line"]                        # a position: document and line
MANY = 2                                       # 2^MANY lines are substantial by number


def place(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("o"),
            F.xxhash64(present(F.col(text_col))).alias("h")]


def later(first: str = "first") -> Column:
    return F.struct(*AT) > F.col(first)


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose key occurs at several positions, with the first of these."""
    first = F.min(F.struct(*AT)).alias("first")
    groups = rows.groupBy(*key).agg(first, F.max(F.struct(*AT)).alias("last"))
    return rows.join(groups.filter("first < last").drop("last"), list(key))


def numbered_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``o, h, line, k1, k2, words``: every line with a 128-bit hash and its number of words."""
    text = docs.select(*place(id_col, text_col), F.posexplode(
        F.split(present(F.col(text_col)), "\n")).alias("line", "value"))
    return text.select(*AT, F.xxhash64("value").alias("k1"),
                       F.xxhash64(F.lit(1), "value").alias("k2"),
                       F.regexp_count("value", F.lit(WORD)).alias("words"))


def doubled(classes: DataFrame, k: int) -> DataFrame:
    """The classes of 2^(k+1) lines from those of 2^k."""
    right = classes.select("o", "h", (F.col("line") - (1 << k)).alias("line"),
                           F.col("name").alias("next"))
    pairs = classes.join(right, AT)
    return (repeated(pairs, "name", "next")
            .select(*AT, F.col("first").alias("name")))


def repeated_runs(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The repeated lines with their words, and the classes of 1, 2, 4, ... lines."""
    # a document that is there twice counts once
    base = cut_lineage(repeated(lines, "k1", "k2").groupBy(*AT).agg(
        F.first("words").alias("words"), F.first("first").alias("name")))
    levels = [base.select(*AT, "name")]
    while True:
        more = cut_lineage(doubled(levels[-1], len(levels) - 1))
        if more.isEmpty():
            return base, levels
        levels.append(more)


def deletions(lines: DataFrame, min_words: int = 8) -> DataFrame:
    """``o, h, line`` of every line to delete."""
    base, levels = repeated_runs(lines)
    long_, here = F.col("words") >= min_words, F.col("line")
    out = [base.filter(long_ & later("name")).select(*AT)]
    if len(levels) > MANY:
        out.append(levels[MANY].filter(later("name")).select(
            "o", "h", F.explode(F.sequence(here, here + (1 << MANY) - 1)).alias("line")))
    # a short line beside a long one: the run from it to the nearest long line on either side
    doc = Window.partitionBy("o", "h").orderBy("line")
    run = base.withColumn("island", here - F.row_number().over(doc))
    island = Window.partitionBy("o", "h", "island").orderBy("line")
    back = F.last(F.when(long_, here), True).over(
        island.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(F.when(long_, here), True).over(
        island.rowsBetween(0, Window.unboundedFollowing))
    near = run.select(*AT, "words", "name", back.alias("back"), ahead.alias("ahead"))
    # copies of such a run have the same lines, so they give the same kind of span
    spans = near.filter(~long_).select("o", "h", here.alias("short"), F.explode(F.array(
        F.struct(F.col("back").alias("start"), here.alias("stop")),
        F.struct(here.alias("start"), F.col("ahead").alias("stop")))).alias("s"))
    size = F.col("s.stop") - F.col("s.start") + 1
    spans = spans.filter("s.start IS NOT NULL AND s.stop IS NOT NULL").select(
        "o", "h", "short", F.col("s.start").alias("line"), size.alias("size"),
        F.floor(F.log2(size)).cast("int").alias("k"))
    # two overlapping runs of 2^k lines name a run of any length between
    every = reduce(DataFrame.unionByName, [
        x.withColumn("k", F.lit(k)) for k, x in enumerate(levels)])
    tail = every.select("o", "h", F.col("line").alias("end"), "k", F.col("name").alias("next"))
    end = F.expr("line + size - shiftleft(1, k)")
    named = (spans.join(every, [*AT, "k"]).withColumn("end", end)
             .join(tail, ["o", "h", "end", "k"]))
    out.append(repeated(named, "size", "k", "name", "next").filter(later())
               .select("o", "h", F.col("short").alias("line")))
    return reduce(DataFrame.unionByName, out).distinct()


def without_repeats(docs: DataFrame, min_words: int = 8, id_col: str = "doc_id",
                    text_col: str = "text", gone_col: str = "__gone",
                    before_col: str = "__before") -> DataFrame:
    """``docs`` with ``gone_col``, the deleted line numbers, and its text without them.

    The text before is in ``before_col``; neither may be a column of ``docs``.
    """
    lines = spool(numbered_lines(docs, id_col, text_col))
    found = spool(deletions(lines, min_words).groupBy("o", "h").agg(
        F.sort_array(F.collect_list(F.col("line").cast("int"))).alias("gone")))
    cost = found.agg(F.max(F.size("gone"))).first()[0] or 0
    found = broadcast_within(found, 48 + 8 * cost)
    o, h = unused(docs, "o"), unused(docs, "h")
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(place(id_col, text_col), (o, h))])
    joined = keyed.join(found.select(F.col("o").alias(o), F.col("h").alias(h),
                                     F.col("gone").alias(gone_col)), [o, h], "left")
    # the kept lines lie between the deleted ones; bound once, so the work is linear
    split = F.split(F.col(f"`{text_col}`"), "\n")
    bound = F.struct(split.alias("lines"), F.concat(
        F.array(F.lit(-1)), F.col(gone_col), F.array(F.size(split))).alias("edges"))

    def kept(s: Column) -> Column:
        def between(k: Column) -> Column:
            low, high = F.get(s["edges"], k), F.get(s["edges"], k + 1)
            return F.slice(s["lines"], low + 2, high - low - 1)
        return F.array_join(F.flatten(F.transform(
            F.sequence(F.lit(0), F.size(s["edges"]) - 2), between)), "\n")
    left = F.transform(F.array(bound), kept)[0]
    before = F.col(f"`{text_col}`")
    text = F.when(F.col(gone_col).isNull(), before).otherwise(left)
    names = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*names, before.alias(before_col), F.coalesce(
        gone_col, F.array().cast("array<int>")).alias(gone_col))


def deduplicated(docs: DataFrame, min_words: int = 8, id_col: str = "doc_id",
                 text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text."""
    gone, before = unused(docs, "gone"), unused(docs, "before")
    out = without_repeats(docs, min_words, id_col, text_col, gone, before)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.size(gone) > 0, F.length(f"`{text_col}`"))
                             .otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
