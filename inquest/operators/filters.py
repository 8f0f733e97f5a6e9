"""Row and column selection rules."""

from __future__ import annotations

import re
import uuid

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from inquest.constants import (AGGREGATES, OPERATIONS, SCOPE_DATE_HINTS,
                               SQL_BANNED)
from inquest.functions.dates import parsed_column
from inquest.functions.tables import is_time


def where_equal(df: DataFrame, filters: dict | None) -> DataFrame:
    """Rows whose values, read as text, equal every given value."""
    for name, value in (filters or {}).items():
        df = df.where(F.col(f"`{name}`").cast("string") == F.lit(str(value)))
    return df


def scope_column(df: DataFrame) -> str | None:
    """First column that holds dates or is named like one."""
    for f in df.schema:
        if is_time(f.dataType) or any(h in f.name.lower() for h in SCOPE_DATE_HINTS):
            return f.name
    return None


def period_scope(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows dated within the window, however few they are."""
    name = scope_column(df)
    if name is None or not (start or end):
        return df
    ts = parsed_column(df, name)
    keep = ts.isNotNull()
    if start:
        keep = keep & (ts >= F.lit(start).cast("timestamp"))
    if end:
        keep = keep & (ts <= F.lit(end).cast("timestamp"))
    return df.where(keep)


def split_sides(df: DataFrame, date: str, cutoff: str | dt.datetime) -> DataFrame:
    """Rows with a usable date, marked ``before`` or ``after`` the cutoff."""
    ts = parsed_column(df, date)
    return df.where(ts.isNotNull()).withColumn(
        "side", F.when(ts < F.lit(cutoff).cast("timestamp"), "before").otherwise("after"))


def visible(df: DataFrame, user: str | None = None, admin: bool = False,
            owner: str = "owner_id", deleted: str | None = "is_deleted") -> DataFrame:
    """Not soft-deleted and, for anyone but an administrator, owned by the user."""
    if deleted and deleted in df.columns:
        df = df.where(~F.coalesce(F.col(deleted), F.lit(False)))
    if not admin:
        df = df.where(F.col(owner) == F.lit(user))
    return df


LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'", re.S)
#: Leaves of a plan that read nothing: a row without columns, written rows, a named part above.
NO_SOURCE = ("OneRowRelation", "LocalRelation", "CTERelationRef")


def guard_sql(query: str, banned: tuple = SQL_BANNED, starts: tuple = ("select", "with")) -> str:
    """The statement without its closing semicolon, or an error when it is not a plain read."""
    text = query.strip().rstrip(";")
    lowered = LITERAL.sub("''", text.lower())          # words inside text are data
    if not lowered.startswith(starts):
        raise ValueError("Only SELECT statements are allowed")
    for word in banned:
        if f" {word} " in f" {lowered} ":
            raise ValueError(f"Forbidden keyword in the statement: {word}")
    return text


def sources_of(df: DataFrame) -> tuple[list, set[str]]:
    """The leaves of a table's analysed plan and the views it names, those inside subqueries too."""
    plan = df._jdf.queryExecution().analyzed()
    plans = [plan, *_each(plan.subqueriesAll())]
    views = {name for p in plans for name in re.findall(r"View \((`[^,]+`)", p.toString())}
    return [leaf for p in plans for leaf in _each(p.collectLeaves())], views


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def readonly_sql(df: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """A guarded SELECT over the table, which it sees as the view ``data``; whole by default.

    The analysed plan is inspected: a statement that reads anything else, another view, a catalog
    table or a path, is refused before it runs.
    """
    text = guard_sql(query)
    session = df.sparkSession
    view = f"data_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        found = session.sql(f"WITH data AS (SELECT * FROM {view}) SELECT * FROM ({text})")
    finally:
        session.catalog.dropTempView(view)
    (given, known), (leaves, views) = sources_of(df), sources_of(found)
    if views - known - {f"`{view}`"} or not all(
            leaf.nodeName() in NO_SOURCE or any(leaf.sameResult(g) for g in given) for leaf in leaves):
        raise ValueError("The statement may only read the view data")
    return found if limit is None else found.limit(limit)


def check_operation(operation: str, agg: str | None = None) -> None:
    if operation not in OPERATIONS:
        raise ValueError(f"Operation not allowed: {operation}. Use one of {list(OPERATIONS)}")
    if agg is not None and agg not in AGGREGATES:
        raise ValueError(f"Aggregate not allowed: {agg}. Use one of {list(AGGREGATES)}")
