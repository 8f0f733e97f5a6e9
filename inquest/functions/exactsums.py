"""Sums of floating numbers that do not depend on the order of the rows.

A number is cut into whole parts of 30 bits at fixed places, down to 2^-60; the parts are added as
whole numbers, carried, and put together once. Any partitioning and any retry gives the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

BITS, TOP = 30, 60
MASK, LOW = (1 << BITS) - 1, 2.0 ** -60


def _digits(parts: Column) -> Column:
    """The same number carried: digits between 0 and ``MASK``, and what is left above them."""
    start = F.struct(F.lit(0).cast("long").alias("left"), F.array().cast("array<bigint>").alias("digits"))
    return F.aggregate(F.reverse(parts), start, lambda state, part: F.struct(
        F.shiftright(part + state["left"], BITS).alias("left"),
        F.concat(F.array((part + state["left"]).bitwiseAND(F.lit(MASK))), state["digits"]).alias("digits")))


def _size(carried: Column) -> Column:
    """A carried number as a double, from the smallest digit on."""
    state = F.struct(F.lit(0.0).alias("total"), F.lit(LOW).alias("unit"))
    return F.aggregate(F.reverse(carried["digits"]), state, lambda s, digit: F.struct(
        (s["total"] + digit.cast("double") * s["unit"]).alias("total"), (s["unit"] * 2.0 ** BITS).alias("unit")),
        lambda s: s["total"] + carried["left"].cast("double") * s["unit"])


def _together(parts: Column) -> Column:
    """Below zero the digits of the opposite number are put together, so that nothing cancels."""
    opposite = F.transform(parts, lambda p: -p)
    return F.when(_digits(parts)["left"] < 0, -F.transform(F.array(_digits(opposite)), _size)[0]).otherwise(
        F.transform(F.array(_digits(parts)), _size)[0])


def exact_sum(value: Column) -> Column:
    """The sum of a double column, null without values.

    What lies below 2^-60 in a value is left out. Sums that hold infinite or undefined values, or
    values beyond 2^92, are added as Spark adds them.
    """
    x = value.cast("double")
    plain = ~F.isnan(x) & (F.abs(x) < 2.0 ** (TOP + 32))
    kept, parts = F.when(plain, x), []
    for place in range(TOP, -TOP - 1, -BITS):                  # remainders of powers of two are exact
        rest = kept if place == TOP else kept % 2.0 ** (place + BITS)
        parts.append(F.try_sum((rest * 2.0 ** -place).cast("long")))
    total = F.transform(F.array(F.array(*parts)), _together)[0]
    return F.when(F.count_if(value.isNotNull() & ~F.coalesce(plain, F.lit(False))) == 0,
                  F.coalesce(total, F.sum(x))).otherwise(F.sum(x))


def steady_sum(df: DataFrame, name: str, value: Column | None = None) -> Column:
    """The sum of a column: exact for floating numbers as for whole ones."""
    value = F.col(f"`{name}`") if value is None else value
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return exact_sum(value) if floating else F.sum(value)
