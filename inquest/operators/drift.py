"""Changes in schema and distribution between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from inquest.constants import PSI_MAJOR, PSI_MODERATE
from inquest.functions.quantiles import quantile_values
from inquest.functions.tables import is_numeric, long_form

MIN_ROWS, BUCKETS, FLOOR, LISTED_LABELS = 10, 10, 1e-6, 10
DRIFT_SCHEMA = ("`column` string, type_changed string, severity string, psi double, "
                "mean_before double, mean_after double, max_share_change double, "
                "changed_label string, new_labels array<string>, missing_labels array<string>, "
                "null_rate_change double")


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``column`` and ``change``: added, removed, type_changed or same."""
    old = {f.name: f.dataType.simpleString() for f in before.schema}
    new = {f.name: f.dataType.simpleString() for f in after.schema}
    rows = [(c, "added" if c not in old else "removed" if c not in new
             else "type_changed" if old[c] != new[c] else "same", old.get(c), new.get(c))
            for c in dict.fromkeys([*new, *old])]
    return before.sparkSession.createDataFrame(
        rows, "`column` string, change string, type_before string, type_after string")


def _bucket_counts(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Rows per column and bucket. Every bucket is half open, the outer ones unbounded."""
    cells = long_form(df, list(edges), "double").where("value IS NOT NULL")
    inner = F.create_map(*[x for c, e in edges.items()
                           for x in (F.lit(c), F.array(*[F.lit(float(v)) for v in e[1:-1]]))])
    value = F.col("value")
    bucket = F.size(F.filter(inner[F.col("column")], lambda e: e <= value))
    return cells.groupBy("column", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def psi(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """``column`` and ``psi``, with deciles of the earlier version as buckets."""
    spark = before.sparkSession
    q = quantile_values(before, columns, [i / BUCKETS for i in range(BUCKETS + 1)])
    edges = {c: sorted(set(v)) for c, v in q.items()}
    edges = {c: e for c, e in edges.items() if len(e) >= 3}
    none = spark.createDataFrame([(c,) for c in columns], "`column` string")
    if not edges:
        return none.withColumn("psi", F.lit(0.0))
    grid = spark.createDataFrame([(c, b) for c, e in edges.items() for b in range(len(e) - 1)],
                                 "`column` string, bucket int")
    counts = (F.broadcast(grid)
              .join(_bucket_counts(before, edges).withColumnRenamed("n", "a"), ["column", "bucket"], "left")
              .join(_bucket_counts(after, edges).withColumnRenamed("n", "b"), ["column", "bucket"], "left")
              .fillna(0, ["a", "b"]))
    whole = Window.partitionBy("column")
    shares = counts.select(
        "column", F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb"), "a", "b")
    p = F.greatest(F.col("a") / F.col("na"), F.lit(FLOOR))
    c = F.greatest(F.col("b") / F.col("nb"), F.lit(FLOOR))
    usable = (F.col("na") >= MIN_ROWS) & (F.col("nb") >= MIN_ROWS)
    total = shares.groupBy("column").agg(
        F.sum(F.when(usable, (c - p) * F.ln(c / p)).otherwise(0.0)).alias("psi"))
    return none.join(F.broadcast(total), "column", "left").fillna(0.0, ["psi"])


def category_shift(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: the label whose share moved most, and labels that came or went."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = (long_form(df, columns, "string", name="column", value="label")
                  .where("label IS NOT NULL").groupBy("column", "label")
                  .agg(F.count(F.lit(1)).alias("n")))
        totals = F.broadcast(counts.groupBy("column").agg(F.sum("n").alias("all")))
        return counts.join(totals, "column").select(
            "column", "label", (F.col("n") / F.col("all")).alias(name))
    both = shares(before, "p").join(shares(after, "c"), ["column", "label"], "full_outer")
    moved = F.abs(F.coalesce("c", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)))
    kind = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "missing")
    both = both.select("column", "label", moved.alias("moved"), kind.alias("kind"))
    # the smallest of equally moved labels
    top = Window.partitionBy("column").orderBy(F.desc("moved"), "label")
    first = both.withColumn("k", F.row_number().over(top)).where("k = 1").select(
        "column", F.when(F.col("moved") > 0, F.col("label")).alias("changed_label"),
        F.round("moved", 4).alias("max_share_change"))
    listed = Window.partitionBy("column", "kind").orderBy("label")
    few = (both.where("kind IS NOT NULL").withColumn("k", F.row_number().over(listed))
           .where(F.col("k") <= LISTED_LABELS).groupBy("column").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "new", F.col("label")))).alias("new_labels"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "missing", F.col("label"))))
        .alias("missing_labels")))
    empty = F.array().cast("array<string>")
    return first.join(few, "column", "left").select(
        "column", "max_share_change", "changed_label",
        F.coalesce("new_labels", empty).alias("new_labels"),
        F.coalesce("missing_labels", empty).alias("missing_labels"))


def null_rates(df: DataFrame, columns: list[str], numeric: list[str], suffix: str) -> DataFrame:
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(F.count(f"`{c}`").alias("present"),
                 (F.avg(f"`{c}`") if c in numeric else F.lit(None)).cast("double").alias("mean"))
        .alias(f"c{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(
        F.lit(c).alias("column"), (1 - F.col(f"c{i}.present") / F.col("rows")).alias(f"null_{suffix}"),
        F.col(f"c{i}.mean").alias(f"mean_{suffix}")) for i, c in enumerate(columns)])
    return wide.select(F.explode(cells).alias("r")).select("r.*")


def detect_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per shared column, the most severe first."""
    old = {f.name: f.dataType for f in before.schema}
    shared = [f for f in after.schema if f.name in old]
    numbers = [f.name for f in shared if is_numeric(f.dataType) and is_numeric(old[f.name])]
    labels = [f.name for f in shared if f.name not in numbers]
    names = [f.name for f in shared]
    spark = before.sparkSession
    base = spark.createDataFrame(
        [(i, f.name, None if f.dataType == old[f.name] else
          f"{old[f.name].simpleString()} -> {f.dataType.simpleString()}", f.name in numbers)
         for i, f in enumerate(shared)],
        "position int, `column` string, type_changed string, is_number boolean")
    out = base
    for suffix, df in (("before", before), ("after", after)):
        out = out.join(null_rates(df, names, numbers, suffix), "column", "left")
    scores = (psi(before, after, numbers) if numbers
              else spark.createDataFrame([], "`column` string, psi double"))
    shift = (category_shift(before, after, labels) if labels else spark.createDataFrame(
        [], "`column` string, max_share_change double, changed_label string, "
            "new_labels array<string>, missing_labels array<string>"))
    out = out.join(scores, "column", "left").join(shift, "column", "left")
    size = F.when(F.col("is_number"), F.col("psi")).otherwise(F.coalesce("max_share_change", F.lit(0.0)))
    change = F.col("null_after") - F.col("null_before")
    severity = (F.when(F.abs(change) > 0.05, "high").when(size > PSI_MAJOR, "high")
                .when(size > PSI_MODERATE, "medium").otherwise("low"))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return (out.withColumn("severity", severity)
            .withColumn("null_rate_change", F.when(F.abs(change) > 0.05, F.round(change, 4)))
            .orderBy(rank, "position")
            .select("column", "type_changed", "severity", F.round("psi", 4).alias("psi"),
                    F.round("mean_before", 4).alias("mean_before"),
                    F.round("mean_after", 4).alias("mean_after"), "max_share_change",
                    "changed_label", "new_labels", "missing_labels", "null_rate_change"))


def verdict(drift: DataFrame) -> DataFrame:
    """One sentence over the columns, and the names of those that drifted."""
    worst = F.max(F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1)
                  .otherwise(0))
    return drift.agg(
        F.when(worst == 2, "major drift: the versions are not directly comparable")
        .when(worst == 1, "moderate drift: compare with care")
        .otherwise("no meaningful drift").alias("verdict"),
        F.sort_array(F.collect_list(F.when(F.col("severity") != "low", F.col("column"))))
        .alias("drifted_columns"))
