"""Rows that repeat in every column, found by their hashes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inquest.functions.tables import broadcast_if_small
from inquest.session import cut_lineage


def row_hashes(columns: list[str]) -> tuple[Column, Column]:
    """Two hashes of a row; a missing value counts by its place."""
    cells = [F.col(f"`{c}`") for c in columns]
    missing = [c.isNull() for c in cells]
    return F.xxhash64(*cells, *missing), F.xxhash64(F.lit(1), *missing, *cells)


def _marked(df: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows with their hashes, and the hashes that repeat: 16 bytes a row are shuffled."""
    names = ["h1_", "h2_"]
    while {n.lower() for n in df.columns} & set(names):
        names = [f"_{n}" for n in names]
    first, second = row_hashes(df.columns)
    marked = df.select("*", first.alias(names[0]), second.alias(names[1]))
    again = (marked.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*names))
    return marked, cut_lineage(again), names


def repeated_rows(df: DataFrame) -> DataFrame:
    """Every row that occurs more than once, with how often (``copies``), compared in whole.

    Only rows whose hashes repeat are shuffled; they are counted before, so copies of one row do
    not gather in a task.
    """
    marked, again, names = _marked(df)
    count = "copies"
    while count in {c.lower() for c in df.columns}:
        count += "_"
    some = marked.join(broadcast_if_small(again), names, "left_semi").drop(*names)
    return some.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(
        F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)


def duplicate_count(df: DataFrame) -> DataFrame:
    """``duplicate_rows``: how many rows repeat an earlier one."""
    found = repeated_rows(df)
    return found.agg(F.coalesce(F.sum(F.col(found.columns[-1]) - 1), F.lit(0)).alias("duplicate_rows"))


def without_duplicates(df: DataFrame) -> DataFrame:
    """Each different row once; rows whose hashes are unique stay where they are."""
    marked, again, names = _marked(df)
    if again.isEmpty():
        return df
    again = broadcast_if_small(again)
    once = marked.join(again, names, "left_anti").drop(*names)
    return once.unionByName(marked.join(again, names, "left_semi").drop(*names).distinct())
