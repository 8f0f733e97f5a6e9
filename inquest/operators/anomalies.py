"""Outliers per column and rows that are odd in combination."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

from inquest.functions.quantiles import quantile_values
from inquest.functions.tables import numeric_columns, spread

TREES, TREE_SAMPLE, MAX_Z = 150, 256, 8.0
POOL_ROWS = TREES * TREE_SAMPLE


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])


def outlier_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: quartiles, rows outside 1.5 IQR, and rows with a robust z above 3.5.

    The z-score uses the median absolute deviation, or the mean absolute deviation
    when more than half of the values are equal.
    """
    columns = list(columns or numeric_columns(df))
    rows = _doubles(df, columns)
    q = quantile_values(rows, columns, [0.25, 0.5, 0.75])
    columns = [c for c in columns if c in q]
    if not columns:
        return df.sparkSession.createDataFrame([], OUTLIERS)
    away = rows.select(*[F.abs(F.col(f"`{c}`") - q[c][1]).alias(c) for c in columns])
    mad = quantile_values(away, columns, [0.5])
    means = away.agg(*[F.avg(f"`{c}`").alias(c) for c in columns]).first()
    parts, scales = [], {}
    for i, c in enumerate(columns):
        low, mid, high = q[c]
        iqr = high - low
        scale, constant = (mad[c][0], 0.6745) if mad[c][0] > 0 else (means[c], 0.7979)
        scales[c] = scale
        v = F.col(f"`{c}`")
        outside = (v < low - 1.5 * iqr) | (v > high + 1.5 * iqr)
        z = constant * F.abs(v - mid) / scale if scale > 0 else F.lit(0.0)
        parts += [F.count(v).alias(f"n{i}"),
                  (F.count_if(outside) if iqr > 0 else F.lit(0)).cast("long").alias(f"o{i}"),
                  F.count_if(z > 3.5).alias(f"e{i}")]
    wide = rows.agg(*parts)
    cells = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
        F.lit(float(q[c][0])).alias("q1"), F.lit(float(q[c][1])).alias("median"),
        F.lit(float(q[c][2])).alias("q3"), F.lit(float(scales[c])).alias("scale"),
        F.when(F.col(f"n{i}") > 4, F.col(f"o{i}")).otherwise(0).cast("long").alias("outliers"),
        F.when(F.col(f"n{i}") > 4, F.col(f"e{i}")).otherwise(0).cast("long")
        .alias("extreme_outliers")) for i, c in enumerate(columns)])
    return wide.select(F.explode(cells).alias("r")).select("r.*")


OUTLIERS = ("column string, count long, q1 double, median double, q3 double, scale double, "
            "outliers long, extreme_outliers long")


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    deep = 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator) -> list[list[float]]:
    """One isolation tree as rows of (feature or -1, threshold, left, right, path length)."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[list[float]] = []
    todo = [(np.arange(len(points)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        part = points[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
        if depth >= limit or len(rows) <= 1 or len(spread) == 0:
            nodes.append([-1, 0.0, at, at, depth + float(_average_path(len(rows)))])
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        nodes.append([f, cut, 0, 0, 0.0])
        goes_left = part[:, f] <= cut
        todo += [(rows[goes_left], depth + 1, at, 0), (rows[~goes_left], depth + 1, at, 1)]
    return nodes


def _pool(rows: DataFrame, columns: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A sample of about ``POOL_ROWS`` rows, the same under any partitioning.

    Equal rows are counted first and then thinned by a hash, so a row that makes up
    a third of the table is one entry with a large count.
    """
    share = min(1.0, POOL_ROWS / n)
    uniform = F.pmod(F.xxhash64(*[f"`{c}`" for c in columns]), F.lit(1 << 52)) / float(1 << 52)
    kept = (rows.groupBy(*[f"`{c}`" for c in columns]).agg(F.count(F.lit(1)).alias("copies_"))
            .withColumn("copies_", F.floor(F.col("copies_") * share + uniform))
            .where("copies_ > 0").toPandas().sort_values(columns, kind="stable"))
    return kept[columns].to_numpy(dtype=float), kept["copies_"].to_numpy(dtype=float)


def anomaly_scores(df: DataFrame, columns: list[str] | None = None,
                   keep: list[str] = ()) -> DataFrame | None:
    """``keep`` columns plus ``score`` (higher is odder) for rows complete in ``columns``.

    150 trees are grown in parallel, one task group each, and travel to the executors
    as one small array; rows are scored in Arrow batches without a shuffle.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return None
    rows = df.select(*keep, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x_"),
                     *[F.col(f"`{c}`").cast("double").alias(f"d_{i}") for i, c in enumerate(columns)])
    features = [f"d_{i}" for i in range(len(columns))]
    rows = spread(rows.dropna(subset=features))
    n = rows.count()
    if n < 50:
        return None
    spark = df.sparkSession
    pool = spark.sparkContext.broadcast(_pool(rows, features, n))
    size = min(TREE_SAMPLE, n)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        points, copies = pool.value
        out = []
        for tree in pdf["id"]:
            rng = np.random.default_rng([7, int(tree)])
            whole = np.repeat(np.arange(len(points)), copies.astype(int))
            pick = rng.choice(whole, size=min(size, len(whole)), replace=False)
            out += [[int(tree), i, *node] for i, node in enumerate(_grow(points[pick], rng))]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "left", "right", "path"])

    trees = (spark.range(TREES).groupBy("id").applyInPandas(
        grow, "tree long, node long, feature double, cut double, left double, right double, "
              "path double").toPandas().sort_values(["tree", "node"], kind="stable"))
    start = trees.groupby("tree")["node"].count().cumsum().shift(fill_value=0)
    offset = trees["tree"].map(start).to_numpy()
    forest = spark.sparkContext.broadcast((
        start.to_numpy(dtype=np.int64), trees["feature"].to_numpy(dtype=np.int64),
        trees["cut"].to_numpy(), (trees["left"].to_numpy() + offset).astype(np.int64),
        (trees["right"].to_numpy() + offset).astype(np.int64), trees["path"].to_numpy()))
    depth = math.ceil(math.log2(max(size, 2)))
    usual = float(_average_path(size))

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        roots, feature, cut, left, right, path = forest.value
        points = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
        total = np.zeros(len(points))
        row = np.arange(len(points))
        for root in roots:
            at = np.full(len(points), root)
            for _ in range(depth):
                f = feature[at]
                goes_left = points[row, np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(goes_left, left[at], right[at]))
            total += path[at]
        return pd.Series(2.0 ** (-(total / len(roots)) / usual))

    return rows.select(*keep, score("x_").alias("score"))


def anomalous_rows(df: DataFrame, columns: list[str] | None = None) -> int:
    """How many rows score more than eight robust deviations above the median score."""
    scored = anomaly_scores(df, columns)
    if scored is None:
        return 0
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        median = quantile_values(scored, ["score"], [0.5])["score"][0]
        away = scored.select(F.abs(F.col("score") - median).alias("away"))
        mad = quantile_values(away, ["away"], [0.5])["away"][0] or 1e-9
        return scored.where(0.6745 * (F.col("score") - median) / mad > MAX_Z).count()
    finally:
        scored.unpersist()
