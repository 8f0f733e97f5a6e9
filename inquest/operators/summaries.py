"""Descriptive aggregates, group totals, time series and chart frames."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from inquest.functions.dates import (parsed_column, period_label, period_start, with_spine)
from inquest.functions.exactsums import exact_sum, steady_sum
from inquest.functions.quantiles import column_quantiles, grouped_quantiles
from inquest.functions.strings import group_label
from inquest.functions.tables import numeric_columns, require_columns
from inquest.operators.filters import check_operation

EMPTY_IS_ZERO = ("sum", "count", "nunique")


def aggregate(agg: str, value: Column) -> Column:
    """One whitelisted aggregate; ``median`` is not here because it needs ranks."""
    check_operation("groupby_aggregate", agg)
    return {
        "sum": lambda: F.coalesce(F.sum(value), F.lit(0)).cast("double"),
        "mean": lambda: F.avg(value),
        "count": lambda: F.count(value).cast("double"),
        "min": lambda: F.min(value).cast("double"),
        "max": lambda: F.max(value).cast("double"),
        "std": lambda: F.stddev_samp(value),
        "nunique": lambda: F.count_distinct(value).cast("double"),
    }[agg]()


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max per numeric column."""
    columns = list(columns or numeric_columns(df))
    require_columns(df, *columns)
    wide = df.agg(*[F.struct(
        F.count(f"`{c}`").alias("count"), F.avg(f"`{c}`").alias("mean"),
        F.stddev_samp(f"`{c}`").alias("std"), F.min(f"`{c}`").cast("double").alias("min"),
        F.max(f"`{c}`").cast("double").alias("max")).alias(f"s{i}")
        for i, c in enumerate(columns)])
    moments = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s"))
        for i, c in enumerate(columns)])).alias("r")).select("r.column", "r.s.*")
    quartiles = F.broadcast(column_quantiles(df, columns, [0.25, 0.5, 0.75]))
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def value_counts(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    value = F.col(f"`{column}`")
    return (df.where(value.isNotNull()).groupBy(value.cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "value").limit(limit))


def group_values(df: DataFrame, by: list[str], metric: str, agg: str = "sum") -> DataFrame:
    """One aggregated value per group; missing keys form their own group."""
    check_operation("groupby_aggregate", agg)
    value = F.col(f"`{metric}`")
    if agg == "median":
        keys = df.groupBy(*by).agg(F.count(value).alias("n"))
        q = grouped_quantiles(df, by, metric, [0.5])
        a, b = keys.alias("a"), q.alias("b")
        same = F.lit(True)
        for k in by:
            same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
        return a.join(b, same, "left").select(*[F.col(f"a.`{k}`") for k in by],
                                              F.col("b.q")[0].alias("value"))
    if agg == "nunique":
        # two steps, so a group with very many values is spread over tasks first
        return (df.groupBy(*by, value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
                .groupBy(*by).agg(F.count("v").cast("double").alias("value")))
    if agg == "sum":                     # whatever the order of the rows
        return df.groupBy(*by).agg(F.coalesce(steady_sum(df, metric), F.lit(0)).cast("double").alias("value"))
    return df.groupBy(*by).agg(aggregate(agg, value).alias("value"))


def groupby_aggregate(df: DataFrame, by: str | list[str], metric: str,
                      agg: str = "sum") -> DataFrame:
    """``group``, ``value`` and, for sums, each group's percentage of the total."""
    by = [by] if isinstance(by, str) else list(by)
    require_columns(df, metric, *by)
    grouped = group_values(df, by, metric, agg)
    rows = grouped.select(group_label(*[F.col(f"`{b}`") for b in by]).alias("group"), "value")
    if agg == "sum":
        total = grouped.agg(exact_sum(F.col("value")).alias("total")).scalar()
        rows = rows.withColumn("share_pct", F.round(F.try_divide(F.col("value"), total) * 100, 2))
    return rows.orderBy(F.desc_nulls_last("value"), "group")


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are present."""
    columns = list(columns or numeric_columns(df))
    pairs = list(itertools.combinations(columns, 2))
    if not pairs:
        raise ValueError("correlation needs at least two numeric columns")
    wide = df.agg(*[F.corr(f"`{a}`", f"`{b}`").alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                               F.round(F.col(f"r{i}"), 4).alias("correlation"))
                      for i, (a, b) in enumerate(pairs)])
    return (wide.select(F.explode(cells).alias("p")).select("p.*")
            .where("correlation IS NOT NULL AND NOT isnan(correlation)")
            .orderBy(F.desc(F.abs("correlation")), "a", "b"))


def period_values(df: DataFrame, date: str, metric: str, freq: str = "M", agg: str = "sum",
                  keys: list[str] = ()) -> DataFrame:
    """Keys, ``period`` (its first day) and ``value``; periods without rows included."""
    keys = list(keys)
    require_columns(df, date, metric, *keys)
    dated = (df.select(*[F.col(f"`{k}`") for k in keys],
                       period_start(parsed_column(df, date), freq).alias("period"),
                       F.col(f"`{metric}`").alias("metric")).where("period IS NOT NULL"))
    series = with_spine(group_values(dated, keys + ["period"], "metric", agg),
                        keys, "period", freq)
    if agg in EMPTY_IS_ZERO:
        series = series.withColumn("value", F.coalesce("value", F.lit(0.0)))
    return series


def time_series(df: DataFrame, date: str, metric: str, freq: str = "M",
                agg: str = "sum") -> DataFrame:
    """``period`` label and ``value`` in time order."""
    return (period_values(df, date, metric, freq, agg)
            .select(period_label(F.col("period"), freq).alias("period"), "value")
            .orderBy("period"))


def build_series(df: DataFrame, date: str, metric: str, freq: str = "M", agg: str = "sum",
                 keys: list[str] = ()) -> DataFrame:
    """The series a forecast is fitted on: like ``time_series`` without empty values."""
    return (period_values(df, date, metric, freq, agg, keys).where("value IS NOT NULL")
            .withColumn("period", period_label(F.col("period"), freq)))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return (df.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull())
            .groupBy(F.col(f"`{a}`").cast("string").alias("a"),
                     F.col(f"`{b}`").cast("string").alias("b"))
            .agg(F.count(F.lit(1)).alias("count")))


def metric_snapshot(df: DataFrame, metric: str, dimensions: list[str]) -> DataFrame:
    """The metric's total, and its total by each of the dimensions, in one pass."""
    dims = [d for d in dimensions if d in df.columns]
    value = F.coalesce(steady_sum(df, metric), F.lit(0)).cast("double").alias("value")
    if not dims:
        return df.agg(value).select(F.lit(None).cast("string").alias("dimension"),
                                    F.lit(None).cast("string").alias("group"), "value")
    # all dimensions sit in the last set's id, so a missing label is told from "all rows"
    levels = df.groupingSets([[]] + [[F.col(f"`{d}`")] for d in dims],
                             *[F.col(f"`{d}`") for d in dims])
    rows = levels.agg(F.grouping_id().alias("gid"), value)
    width = len(dims)
    name, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        mask = (2 ** width - 1) & ~(1 << (width - 1 - i))
        name = F.when(F.col("gid") == mask, d).otherwise(name)
        group = F.when(F.col("gid") == mask, F.col(f"`{d}`").cast("string")).otherwise(group)
    return (rows.select(name.alias("dimension"), group.alias("group"), "value")
            .where("dimension IS NULL OR `group` IS NOT NULL"))


def bar_frame(df: DataFrame, x: str, y: str, agg: str = "sum", limit: int = 20) -> DataFrame:
    """The bars of a chart: largest groups, missing labels left out."""
    return (groupby_aggregate(df.where(F.col(f"`{x}`").isNotNull()), x, y, agg)
            .select("group", "value")
            .orderBy(F.desc_nulls_last("value"), "group").limit(limit))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and largest value, the last one closed."""
    value = F.col(f"`{column}`").cast("double")
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    flat = df.where(value.isNotNull()).select(value.alias("v")).select(
        "v", lo.alias("lo"), hi.alias("hi"))
    same = F.col("lo") == F.col("hi")
    start = F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(same, F.lit(1.0 / bins)).otherwise((F.col("hi") - F.col("lo")) / bins)
    binned = flat.select(
        F.least(F.floor((F.col("v") - start) / width), F.lit(bins - 1)).cast("int").alias("bin"),
        start.alias("start"), width.alias("width"))
    return (binned.groupBy("bin", "start", "width").agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.col("start") + F.col("bin") * F.col("width")).alias("low"),
                    (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("high"), "count")
            .orderBy("bin"))


def scatter_frame(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every complete pair."""
    both = df.where(F.col(f"`{x}`").isNotNull() & F.col(f"`{y}`").isNotNull())
    return both.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y"))


def line_frame(df: DataFrame, x: str, y: str, freq: str = "M", agg: str = "sum") -> DataFrame:
    return time_series(df, x, y, freq, agg)
