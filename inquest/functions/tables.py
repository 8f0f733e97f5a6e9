"""Schema helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

BROADCAST_ROWS = 200_000


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """A missing number is null everywhere downstream, never NaN."""
    def fix(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(col), col).alias(field.name)
        return col
    return df.select(*[fix(f) for f in df.schema])


def long_form(df: DataFrame, columns: list[str], as_type: str, keep: list[str] = (),
              name: str = "column", value: str = "value") -> DataFrame:
    """One row per (row, column), with the values cast to one type."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast(as_type).alias(value))
                      for c in columns])
    return (df.select(*keep, F.explode(cells).alias("cell"))
            .select(*keep, f"cell.{name}", f"cell.{value}"))


def spread(df: DataFrame, bytes_per_core: int = 8 << 20) -> DataFrame:
    """One partition per core for work that is heavy per row, when the input is small.

    A small file is a single task otherwise. Judged by the planner's size estimate, so
    nothing runs; a large input has enough partitions and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * bytes_per_core else df


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after counting it; otherwise leave the join to AQE."""
    return F.broadcast(df) if df.count() <= rows else df


def null_safe_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition
