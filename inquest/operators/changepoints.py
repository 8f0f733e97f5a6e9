"""Where a series changed level, and default comparison periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MIN_POINTS, MARGIN, LINE_TOLERANCE = 8, 2, 1.25


def change_points(series: DataFrame, keys: list[str] = (), period: str = "period",
                  value: str = "value") -> DataFrame:
    """One row per series: ``change_period`` (null when there is none) and ``strength``.

    Two means are compared with one mean for every cut, using running sums of the
    centred values, and with a straight line. A series holds one row per calendar
    period, which bounds the window.
    """
    keys = list(keys)
    everything = Window.partitionBy(*(keys or [F.lit(1)]))
    ordered = everything.orderBy("p")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    s = (series.select(*keys, F.col(period).alias("p"), F.col(value).cast("double").alias("v"))
         .withColumn("n", F.count("v").over(everything))
         .withColumn("d", F.col("v") - F.avg("v").over(everything))
         .withColumn("i", F.row_number().over(ordered) - 1)
         .withColumn("ls", F.sum("d").over(before))
         .withColumn("lq", F.sum(F.col("d") * F.col("d")).over(before))
         .withColumn("ts", F.sum("d").over(everything))
         .withColumn("tq", F.sum(F.col("d") * F.col("d")).over(everything)))
    left = F.col("lq") - F.col("ls") * F.col("ls") / F.col("i")
    rest = F.col("ts") - F.col("ls")
    right = F.col("tq") - F.col("lq") - rest * rest / (F.col("n") - F.col("i"))
    candidate = (F.col("i") >= MARGIN) & (F.col("i") < F.col("n") - MARGIN)
    best = F.min(F.when(candidate, F.struct((left + right).alias("cost"), F.col("i").alias("i"),
                                            F.col("p").alias("p"))))
    fitted = s.groupBy(*keys).agg(
        F.count("v").alias("n"), F.max("tq").alias("total"), best.alias("best"),
        (F.regr_syy("d", "i") - F.regr_sxy("d", "i") * F.regr_sxy("d", "i")
         / F.regr_sxx("d", "i")).alias("line"))
    found = ((F.col("n") >= MIN_POINTS) & (F.col("total") > 0) & F.col("best").isNotNull()
             & (F.col("line") > F.col("best.cost") * LINE_TOLERANCE))
    return fitted.select(
        *keys, "n", F.when(found, F.col("best.p")).alias("change_period"),
        F.when(found, F.greatest(F.lit(0.0), 1 - F.col("best.cost") / F.col("total")))
        .otherwise(0.0).alias("strength"))


def trend_reverses(series: DataFrame, keys: list[str] = (), period: str = "period",
                   value: str = "value") -> DataFrame:
    """Whether the slope changed sign between thirds of each series."""
    keys = list(keys)
    ordered = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("p")
    third = (series.select(*keys, F.col(period).alias("p"), F.col(value).cast("double").alias("v"))
             .withColumn("third", F.ntile(3).over(ordered))
             .withColumn("x", F.row_number().over(ordered)))
    slopes = third.groupBy(*keys, "third").agg(
        F.regr_slope("v", "x").alias("slope"), F.count("v").alias("c"),
        F.sum(F.abs("v")).alias("size"))
    per = slopes.groupBy(*keys).agg(
        F.sum("c").alias("n"), (F.sum("size") / F.sum("c")).alias("scale"),
        F.array_sort(F.collect_list(F.struct("third", "slope"))).alias("parts"))
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    steep = F.transform(F.filter("parts", lambda s: F.abs(s["slope"]) > 0.01 * scale),
                        lambda s: F.signum(s["slope"]))
    turned = F.exists(F.sequence(F.lit(1), F.size(steep) - 1),
                      lambda i: F.element_at(steep, i) * F.element_at(steep, i + 1) < 0)
    return per.select(*keys, "n", (F.when((F.col("n") >= 12) & (F.size(steep) >= 2), turned)
                                   .otherwise(False)).alias("trend_change"))
