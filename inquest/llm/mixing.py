"""Mixing sources to target weights by hash thresholds, without sorting.

Every document has a fixed hash. A source that must give fewer words than it has takes the
documents below a hash threshold; one that must give more takes all of them once and those
below the threshold a second time. The threshold comes from a histogram of words by source and
hash bucket: the bucket in which the budget runs out is cut into buckets again, and only its
documents are read in the next step, until it holds a single hash.

Defined results: a null or empty text has size 0. Sources are ordered by code point, null
last. Rows with equal id and text share a hash, so they are taken together. An empty table
gives an empty result. Nothing depends on partitioning, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inquest.llm.common import WORD, broadcast_within, cut_lineage, present, spool

HASH_BITS, CUT_BITS = 62, 12      # bits of a hash, and those that one histogram resolves


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """``skey, source_size, target``: the budget dealt by weight, no source above its limit.

    One row per source comes in. What a source cannot use is dealt again among the others
    until none is above its limit; a round is one sum over the sources.
    """
    # the place in code point order: ranked inside ranges, then shifted by the ranges before
    ranged = cut_lineage(sources.repartitionByRange("skey").sortWithinPartitions("skey")
                         .withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("skey")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("part").count().withColumn(
        "shift", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "shift")
    place = F.row_number().over(inside) - 1 + F.col("shift")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (place % len(weights) + 1).cast("int"))
    dealt = cut_lineage(ranged.join(shift, "part").withColumn("weight", weight)
                        .select("skey", "source_size", "weight"))
    budget = share * (dealt.agg(F.sum("source_size")).first()[0] or 0)
    rate, limit = 0.0, most * F.col("source_size")
    while True:
        full = F.col("weight") * rate >= limit
        fact = dealt.agg(F.sum(F.when(full, limit).otherwise(0.0)),
                         F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not fact[1] or (budget - fact[0]) / fact[1] <= rate:
            break
        rate = (budget - fact[0]) / fact[1]
    return dealt.select("skey", "source_size",
                        F.least(F.col("weight") * rate, limit).alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """``skey, threshold``: documents whose hash is below it hold nearest to ``extra`` words.

    ``wanted`` has ``skey, extra``; ``sized`` has ``skey, size, u``.
    """
    state = wanted.select("skey", "extra", F.lit(0).cast("long").alias("low"),
                          F.lit(0).cast("long").alias("below"))
    bits, done = HASH_BITS, None          # the interval is 2^bits hashes wide
    while True:
        fine = max(0, bits - CUT_BITS)
        at = F.shiftright(F.col("u") - F.col("low"), fine)
        inside = (F.col("u") >= F.col("low")) & (F.col("u") - F.col("low") < (1 << bits))
        cells = (sized.join(broadcast_within(state, 128), "skey").filter(inside)
                 .groupBy("skey", "extra", "low", "below", at.alias("b"))
                 .agg(F.sum("size").alias("n"), F.min("u").alias("first"),
                      F.max("u").alias("last")))
        run = Window.partitionBy("skey").orderBy("b")
        upto = F.col("below") + F.sum("n").over(run)
        hit = (cells.withColumn("upto", upto).filter(F.col("upto") >= F.col("extra"))
               .withColumn("nth", F.row_number().over(run)).filter("nth = 1"))
        hit = cut_lineage(hit.select(
            "skey", "extra", "first", "last", "n",
            (F.col("low") + F.shiftleft("b", fine)).alias("low"),
            (F.col("upto") - F.col("n")).alias("below")))
        nearer = (F.col("below") + F.col("n") - F.col("extra")) < (F.col("extra") - F.col("below"))
        found = hit.filter("first = last").select(
            "skey", F.when(nearer, F.col("first") + 1).otherwise(F.col("first"))
            .alias("threshold"))
        done = found if done is None else done.unionByName(found)
        state = hit.filter("first < last").select("skey", "extra", "low", "below")
        if state.isEmpty():
            return done
        bits = fine


def place(id_col: str, text_col: str) -> Column:
    """A document's hash, below which thresholds cut."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), present(F.col(text_col))),
                                64 - HASH_BITS)


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, u, source, size, source_size, target, copies`` for every document."""
    skey = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))
    sized = spool(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              skey.alias("skey"), n_words(F.col(text_col)).alias("size"),
                              place(id_col, text_col).alias("u")))
    sources = cut_lineage(sized.groupBy("skey").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sources, weights, share, most)
    base = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    base = F.least(base, F.lit(int(most) - 1)).cast("int")
    plan = cut_lineage(targets.withColumn("base", base).withColumn(
        "extra", F.col("target") - F.col("base") * F.col("source_size")))
    cut = thresholds(sized, plan.filter("source_size > 0").select("skey", "extra"))
    plan = cut_lineage(plan.join(cut, "skey", "left"))
    copies = F.col("base") + F.when(F.col("u") < F.coalesce("threshold", F.lit(0)), 1).otherwise(0)
    return sized.join(broadcast_within(plan, 128), "skey").select("doc_id", "u", "source", "size", "source_size",
                                           "target", copies.cast("int").alias("copies"))
