"""Date parsing, calendar periods and spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from inquest.constants import FREQUENCIES

# Written forms accepted besides ISO 8601; month before day where it is ambiguous.
FORMATS = (
    "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M-d-yyyy", "M.d.yyyy",
    "yyyy/M/d", "yyyy/M/d H:mm:ss", "yyyy.M.d", "yyyyMMdd",
    "d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMM d yyyy", "MMMM d, yyyy",
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy",
)


def parsed(col: Column, dtype: T.DataType | None = None) -> Column:
    """A timestamp, or null where the value is not a date."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp")
    if isinstance(dtype, T.NumericType):
        return F.lit(None).cast("timestamp")
    text = F.trim(col.cast("string"))
    # words without a digit are no dates; a failed attempt costs an exception in the JVM
    return F.when(text.rlike("[0-9]"), F.coalesce(
        F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]))


def parsed_column(df: DataFrame, name: str) -> Column:
    return parsed(F.col(f"`{name}`"), df.schema[name].dataType)


def unit_of(freq: str) -> str:
    if freq not in FREQUENCIES:
        raise ValueError(f"Unknown frequency: {freq}. Use one of {sorted(FREQUENCIES)}")
    return FREQUENCIES[freq]


def period_start(ts: Column, freq: str) -> Column:
    return F.date_trunc(unit_of(freq), ts).cast("date")


def step(freq: str) -> Column:
    unit = unit_of(freq)
    return F.expr("INTERVAL 3 MONTHS" if unit == "quarter" else f"INTERVAL 1 {unit}")


def period_label(start: Column, freq: str) -> Column:
    """Month, quarter and year periods are labelled by their last day, weeks by Sunday.

    ``MS`` keeps the first day.
    """
    unit = unit_of(freq)
    if freq == "MS" or unit == "day":
        return start
    if unit == "week":
        return F.date_add(start, 6)
    months = {"month": 0, "quarter": 2, "year": 11}[unit]
    return F.last_day(F.add_months(start, months))


def later_label(label: Column, periods: Column, freq: str) -> Column:
    """The label ``periods`` steps after ``label``."""
    unit = unit_of(freq)
    if unit == "day":
        return F.date_add(label, periods.cast("int"))
    if unit == "week":
        return F.date_add(label, (periods * 7).cast("int"))
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    moved = F.add_months(label, (periods * months).cast("int"))
    return moved if freq == "MS" else F.last_day(moved)


def with_spine(series: DataFrame, keys: list[str], period: str, freq: str) -> DataFrame:
    """Every period between the first and last of each series; no gaps."""
    span = series.groupBy(*keys).agg(F.min(period).alias("lo"), F.max(period).alias("hi"))
    spine = span.where("lo IS NOT NULL").select(
        *keys, F.explode(F.sequence("lo", "hi", step(freq))).alias("spine"))
    spine = spine.select(*keys, F.col("spine").cast("date").alias(period))
    a, b = spine.alias("a"), series.alias("b")
    match = F.col(f"a.{period}") == F.col(f"b.{period}")
    for k in keys:
        match = match & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    others = [c for c in series.columns if c not in keys + [period]]
    return a.join(b, match, "left").select(
        *[F.col(f"a.`{k}`") for k in keys], F.col(f"a.{period}"),
        *[F.col(f"b.`{c}`") for c in others])
