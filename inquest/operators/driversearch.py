"""Which values, and which pairs of values, of any columns drove a change: a lattice search.

A set of values can only carry a share of the whole change if its weight, the size of its
rows' contributions whatever their sign, reaches that share. Weight only falls as sets grow, so
a pair is worth counting only when both its values have the weight. Values are first counted in
hashed buckets, whose weight bounds that of each value in them; the buckets that reach the
share name the values that are counted exactly. No column is left out for its number of
values: what travels to the rows is bounded by weight and share.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from inquest.functions.tables import broadcast_if_small, long_form
from inquest.operators.contribution import Split, dated_rows, resolve_split
from inquest.session import cut_lineage

BUCKETS = 1 << 14
MIN_SHARE = 20.0


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.sum("change").alias("change"),
                                   F.sum("prev").alias("prev"))


def driver_search(df: DataFrame, date: str, metric: str, dimensions: list[str],
                  split: str | dt.datetime | Split | None = None, share: float = MIN_SHARE,
                  pairs: bool = True) -> DataFrame:
    """``level``, ``dimensions``, ``groups``, the change a month, ``share_pct``, ``base_pct`` and ``lift``.

    All values, and pairs of values of two columns, that carry at least ``share`` per cent of the
    whole change. ``base_pct`` is their part of the metric before the split, ``lift`` what the share
    exceeds it by: a narrow set with a large share stands first. Missing labels form no group; an
    unchanged total has no drivers.
    """
    if not isinstance(split, Split):
        split = resolve_split(df, date, metric, split)
    schema = ("level int, dimensions string, groups string, previous_per_period double, "
              "current_per_period double, change double, share_pct double, base_pct double, lift double")
    late = F.col("ts") >= F.lit(split.cutoff.isoformat(" ")).cast("timestamp")
    value = F.col(f"`{metric}`").cast("double")
    part = F.when(late, value / split.after_months).otherwise(value / split.before_months)
    names = [f"d{i}" for i in range(len(dimensions))]
    rows = dated_rows(df, date, metric, *dimensions).where(value.isNotNull()).select(
        F.abs(part).alias("weight"), F.when(late, part).otherwise(-part).alias("change"),
        F.when(late, 0.0).otherwise(part).alias("prev"),
        *[F.col(f"`{d}`").cast("string").alias(n) for d, n in zip(dimensions, names)])
    total = rows.agg(F.sum("change").alias("change"), F.sum("prev").alias("prev")).first()
    if not dimensions or not total["change"]:
        return df.sparkSession.createDataFrame([], schema)
    least = abs(total["change"]) * share / 100 * (1 - 1e-9)
    heavy_enough = F.col("weight") >= least
    keep = ["weight", "change", "prev"]
    cells = long_form(rows, names, "string", keep, "d", "v").where("v IS NOT NULL")
    bucket = F.pmod(F.xxhash64("v"), F.lit(BUCKETS)).cast("int")
    # at most one row a column and bucket
    full = cells.groupBy("d", bucket.alias("bucket")).agg(F.sum("weight").alias("weight")).where(
        heavy_enough).select("d", "bucket")
    singles = cut_lineage(_sums(cells.withColumn("bucket", bucket).join(
        F.broadcast(full), ["d", "bucket"], "left_semi"), "d", "v").where(heavy_enough))
    label = F.create_map(*[F.lit(x) for n, d in zip(names, dimensions) for x in (n, d)])
    found = singles.select(F.lit(1).alias("level"), label[F.col("d")].alias("dimensions"),
                           F.col("v").alias("groups"), *keep)
    if pairs and len(names) > 1:
        marked = rows
        for n in names:
            own = broadcast_if_small(singles.where(F.col("d") == n).select(F.col("v").alias(n)))
            marked = marked.join(own.withColumn(f"{n}_", F.lit(True)), n, "left")
        some = marked.select(*keep, F.filter(
            F.array(*[F.when(F.col(f"{n}_"), F.struct(F.lit(i).alias("i"), F.lit(n).alias("d"),
                                                      F.col(n).alias("v")))
                      for i, n in enumerate(names)]), lambda c: c.isNotNull()).alias("c"))
        couples = F.flatten(F.transform("c", lambda x: F.transform(
            F.filter("c", lambda y: y["i"] > x["i"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        each = some.where(F.size("c") > 1).select(*keep, F.explode(couples).alias("p")).select(
            *keep, F.col("p.x.d").alias("d"), F.col("p.x.v").alias("v"),
            F.col("p.y.d").alias("e"), F.col("p.y.v").alias("w"))
        both = _sums(each, "d", "v", "e", "w").where(heavy_enough)
        found = found.unionByName(both.select(
            F.lit(2).alias("level"),
            F.concat_ws(" × ", label[F.col("d")], label[F.col("e")]).alias("dimensions"),
            F.concat_ws(" × ", "v", "w").alias("groups"), *keep))
    carried = F.col("change") / total["change"] * 100
    base = F.col("prev") / total["prev"] * 100 if total["prev"] else F.lit(0.0)
    return (found.where(carried >= share).select(
        "level", "dimensions", "groups", F.round("prev", 2).alias("previous_per_period"),
        F.round(F.col("prev") + F.col("change"), 2).alias("current_per_period"),
        F.round("change", 2).alias("change"), F.round(carried, 2).alias("share_pct"),
        F.round(base, 2).alias("base_pct"), F.round(carried - base, 2).alias("lift"))
        .orderBy(F.desc("lift"), "level", "dimensions", "groups"))
