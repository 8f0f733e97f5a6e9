"""Cleaning in two steps: a plan to look at, then the approved part of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from inquest.constants import AMOUNT_HINTS
from inquest.functions.dates import parsed
from inquest.functions.quantiles import quantile_values
from inquest.functions.strings import strip, title_case
from inquest.functions.tables import is_time
from inquest.operators.duplicates import without_duplicates
from inquest.operators.profiling import ColumnFacts, column_facts, duplicate_rows, hinted
from inquest.session import cut_lineage

# Operations in the order they run (fixed values); the first three lose nothing.
OPERATIONS = ("strip_whitespace", "normalize_category_casing", "drop_exact_duplicates",
              "coerce_datetime", "null_out_negative_values", "impute_missing_median",
              "impute_missing_mode", "drop_constant_columns")
SAFE = OPERATIONS[:3]
LOG_SCHEMA = ("op_id string, operation string, `column` string, safe boolean, reason string, "
              "estimated_affected_rows long, executed boolean, skipped_reason string, "
              "actual_affected_rows long")


@dataclass
class Operation:
    operation: str
    column: str | None
    reason: str
    estimated: int
    executed: bool = False
    skipped: str | None = None
    affected: int | None = None

    @property
    def op_id(self) -> str:
        return f"{self.operation}::{self.column}" if self.column else self.operation

    @property
    def safe(self) -> bool:
        return self.operation in SAFE


@dataclass
class Plan:
    operations: list[Operation] = field(default_factory=list)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(o.op_id, o.operation, o.column, o.safe, o.reason, o.estimated, o.executed,
              o.skipped, o.affected) for o in self.operations], LOG_SCHEMA)


def _column_operations(f: ColumnFacts) -> list[Operation]:
    found, m, kind = [], f.measured, f.inferred
    if kind in ("categorical", "text") and isinstance(f.dtype, T.StringType) and f.present:
        if m["padded"]:
            found.append(Operation("strip_whitespace", f.name,
                                   "outer spaces split equal labels", m["padded"]))
        if f.collapsed_distinct < f.stripped_distinct:
            found.append(Operation("normalize_category_casing", f.name,
                                   f"{f.stripped_distinct} labels are {f.collapsed_distinct} "
                                   "apart from case", f.present))
    if kind == "datetime" and not is_time(f.dtype):
        found.append(Operation("coerce_datetime", f.name,
                               f"dates stored as text; {f.present - m['dates']} become missing",
                               f.present))
    if kind == "numeric" and hinted(f.name, AMOUNT_HINTS) and m["negative"]:
        found.append(Operation("null_out_negative_values", f.name,
                               "an amount should not be negative", m["negative"]))
    if f.missing and f.missing / f.rows < 0.4 and kind in ("numeric", "categorical"):
        name = "impute_missing_median" if kind == "numeric" else "impute_missing_mode"
        found.append(Operation(name, f.name, f"{f.missing / f.rows * 100:.1f}% missing", f.missing))
    if f.present and f.distinct == 1:
        found.append(Operation("drop_constant_columns", f.name,
                               "one value cannot explain any variation", f.rows))
    return found


def propose_plan(df: DataFrame) -> Plan:
    """What cleaning would do and to how many rows; nothing is changed."""
    operations = [o for f in column_facts(df).values() for o in _column_operations(f)]
    repeats = duplicate_rows(df).first()["duplicate_rows"]
    if repeats:
        operations.append(Operation("drop_exact_duplicates", None,
                                    "copies of a row count twice in every total", repeats))
    return Plan(sorted(operations, key=lambda o: OPERATIONS.index(o.operation)))


def _apply(df: DataFrame, op: Operation, prefix: str, i: int) -> DataFrame:
    """One operation as a transform. A flag marks the rows it touches, counted later."""
    flag = f"{prefix}{i}"
    if op.operation == "drop_exact_duplicates":
        return without_duplicates(df)
    c = F.col(f"`{op.column}`")
    dtype = df.schema[op.column].dataType
    if op.operation == "drop_constant_columns":
        return df.withColumn(flag, F.lit(True)).drop(op.column)
    if op.operation in ("strip_whitespace", "normalize_category_casing"):
        tidy = strip(c) if op.operation == "strip_whitespace" else title_case(strip(c))
        return df.withColumn(flag, c.isNotNull()).withColumn(op.column, tidy)
    if op.operation == "coerce_datetime":
        ts = parsed(c, dtype)
        return df.withColumn(flag, ts.isNotNull()).withColumn(op.column, ts)
    if op.operation == "null_out_negative_values":
        return df.withColumn(flag, c < 0).withColumn(op.column, F.when(c >= 0, c))
    if op.operation == "impute_missing_median":
        middle = quantile_values(df, [op.column], [0.5]).get(op.column)
        value = F.lit(middle[0] if middle else None)
        # a fractional median must survive in a whole-number column
        filled = F.coalesce(c.cast("double"), value) if middle and middle[0] % 1 else \
            F.coalesce(c, value.cast(dtype))
        return df.withColumn(flag, c.isNull()).withColumn(op.column, filled)
    if op.operation == "impute_missing_mode":
        # most frequent label, the smallest of equals; counted first, so never one big group
        top = (df.where(c.isNotNull()).groupBy(c.alias("label")).agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), "label").limit(1).collect())
        value = F.lit(top[0]["label"]) if top else F.lit(None)
        return df.withColumn(flag, c.isNull()).withColumn(op.column, F.coalesce(c, value.cast(dtype)))
    raise ValueError("unknown operation")


def apply_plan(df: DataFrame, plan: Plan, approved: list[str] = ()) -> tuple[DataFrame, Plan]:
    """The cleaned table and the plan with what happened to each operation.

    Safe operations always run, others only when their id was approved. The input is
    not changed. Touched rows are counted before duplicates go, and once more at the end.
    """
    log = [Operation(o.operation, o.column, o.reason, o.estimated) for o in plan.operations]
    out, dropped, touched, prefix = df, None, {}, "touched_"
    while any(c.startswith(prefix) for c in df.columns):     # a user's column may be named so
        prefix = f"_{prefix}"
    for i, op in enumerate(log):
        if not op.safe and op.op_id not in set(approved):
            op.skipped = "not approved"
            continue
        if op.operation not in OPERATIONS:
            op.skipped = "unknown operation"
            continue
        try:
            if op.operation == "drop_exact_duplicates":
                held = _counted(out, prefix)
                touched |= held
                dropped = (op, held["rows"])
                out = out.drop(*[c for c in out.columns if c.startswith(prefix)])
            done = _apply(out, op, prefix, i)
            if op.operation == "drop_exact_duplicates" and done is not out:
                done = cut_lineage(done)      # the scans that follow do not look for copies again
            out, op.executed = done, True
        except (PySparkException, ValueError) as error:
            op.skipped = f"error: {error}"
    row = _counted(out, prefix)
    touched |= row
    for i, op in enumerate(log):
        if op.executed and f"{prefix}{i}" in touched:
            op.affected = touched[f"{prefix}{i}"]
    if dropped and dropped[0].executed:
        dropped[0].affected = dropped[1] - row["rows"]
    return out.drop(*[c for c in out.columns if c.startswith(prefix)]), Plan(log)


def _counted(df: DataFrame, prefix: str) -> dict[str, int]:
    """The number of rows, and of those that each flag marks."""
    flags = [c for c in df.columns if c.startswith(prefix)]
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(F.col(c)).alias(c) for c in flags]).first().asDict()
