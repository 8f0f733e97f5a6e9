"""Statistical tests on sufficient statistics.

Spark reduces the rows to counts and moments; what is left is one row, and its
p-value is a closed form.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from inquest.functions.distributions import chi_square_upper, student_two_sided
from inquest.functions.strings import effect_label
from inquest.functions.tables import require_columns
from inquest.operators.summaries import contingency

ALPHA = 0.05


def welch_moments(df: DataFrame, value: str, group: str, levels: list[str] | None = None) -> DataFrame:
    """One row with both groups' moments, t, degrees of freedom and Cohen's d."""
    require_columns(df, value, group)
    rows = df.where(F.col(f"`{value}`").isNotNull() & F.col(f"`{group}`").isNotNull()).select(
        F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{value}`").cast("double").alias("v"))
    if levels is None:
        levels = sorted(r["g"] for r in rows.select("g").distinct().limit(3).collect())
    levels = [str(x) for x in levels]
    if len(levels) != 2:
        raise ValueError("a t-test needs exactly two groups; pass `levels` to choose them")
    a, b = ([f(F.when(F.col("g") == g, F.col("v"))) for f in (F.count, F.avg, F.var_samp)]
            for g in levels)
    m = rows.where(F.col("g").isin(*levels)).agg(
        a[0].alias("n_a"), a[1].alias("mean_a"), a[2].alias("var_a"),
        b[0].alias("n_b"), b[1].alias("mean_b"), b[2].alias("var_b"))
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    diff = F.col("mean_a") - F.col("mean_b")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"))
                    / (F.col("n_a") + F.col("n_b") - 2))
    ready = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    d = F.when(pooled > 0, diff / pooled).otherwise(0.0)
    return m.where(ready).select(
        F.lit(levels[0]).alias("group_a"), F.lit(levels[1]).alias("group_b"), "n_a", "n_b",
        "mean_a", "mean_b", F.try_divide(diff, F.sqrt(sa + sb)).alias("statistic"),
        F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1)
                     + sb * sb / (F.col("n_b") - 1)).alias("dof"),
        F.round(d, 4).alias("cohens_d"), effect_label(F.abs(d)).alias("effect_size"))


def welch_ttest(df: DataFrame, value: str, group: str, levels: list[str] | None = None) -> dict:
    row = welch_moments(df, value, group, levels).first()
    if row is None:
        raise ValueError("each group needs at least two observations")
    p = student_two_sided(row["statistic"], row["dof"])
    return row.asDict() | {"test": "welch_ttest", "p_value": p,
                           "significant": p is not None and p < ALPHA}


def chi_square_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square over the full grid of labels; corrected for continuity at one degree.

    A cell nobody falls in adds its expected count, so cells that do occur are
    enough: the sum over the grid is rewritten as a sum over them.
    """
    cells = contingency(df, a, b)
    by_a = cells.groupBy("a").agg(F.sum("count").alias("na"))
    by_b = cells.groupBy("b").agg(F.sum("count").alias("nb"))
    size = by_a.agg(F.count(F.lit(1)).alias("ra"), F.sum("na").alias("n"))
    n, ra = size.select("n").scalar(), size.select("ra").scalar()
    rb = by_b.agg(F.count(F.lit(1)).alias("rb")).scalar()
    full = (cells.join(by_a, "a").join(by_b, "b").withColumn("n", n).withColumn("ra", ra)
            .withColumn("rb", rb)
            .withColumn("e", F.col("na") / F.col("n") * F.col("nb")))
    gap = F.abs(F.col("count") - F.col("e"))
    yates = (F.col("ra") == 2) & (F.col("rb") == 2)
    eased = F.when(yates, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    summed = full.groupBy("n", "ra", "rb").agg(
        F.sum(eased * eased / F.col("e")).alias("seen"), F.sum("e").alias("covered"),
        F.count(F.lit(1)).alias("cells"))
    return summed.select(
        "n", "ra", "rb", "cells",
        (F.col("seen") + F.col("n") - F.col("covered")).alias("statistic"))


def chi_square(df: DataFrame, a: str, b: str) -> dict:
    """Independence of two label columns, with Cramér's V."""
    require_columns(df, a, b)
    row = chi_square_statistic(df, a, b).first()
    if row is None:
        raise ValueError("no rows where both columns are present")
    dof = (row["ra"] - 1) * (row["rb"] - 1)
    stat = 0.0 if dof == 0 else row["statistic"]
    if dof == 1 and row["cells"] < 4:
        # few cells: finish the two-by-two grid directly
        grid = {(r["a"], r["b"]): r["count"] for r in contingency(df, a, b).collect()}
        rows, cols = sorted({k[0] for k in grid}), sorted({k[1] for k in grid})
        table = np.array([[grid.get((x, y), 0) for y in cols] for x in rows], dtype=float)
        expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
        gap = np.abs(table - expected)
        stat = float((((gap - np.minimum(0.5, gap)) ** 2) / expected).sum())
    smaller = min(row["ra"], row["rb"]) - 1
    p = chi_square_upper(stat, dof)
    return {"test": "chi_square", "statistic": stat, "dof": dof, "p_value": p, "n": row["n"],
            "significant": p < ALPHA,
            "cramers_v": round(math.sqrt(stat / (row["n"] * smaller)), 4) if smaller else 0.0}


def pearson(df: DataFrame, a: str, b: str) -> dict:
    require_columns(df, a, b)
    both = df.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull())
    row = both.agg(F.corr(f"`{a}`", f"`{b}`").alias("r"), F.count(F.lit(1)).alias("n")).first()
    r, n = row["r"], row["n"]
    if r is None or math.isnan(r) or n < 3:
        raise ValueError("correlation needs three complete pairs that vary")
    t = math.inf if abs(r) >= 1 else r * math.sqrt((n - 2) / (1 - r * r))
    p = student_two_sided(t, n - 2)
    return {"test": "pearson_correlation", "r": r, "r_squared": r * r, "n": n, "p_value": p,
            "significant": p < ALPHA}


def cross_products(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the count, means and centred cross products of complete rows.

    Population covariances keep the sums centred, so large values do not cancel.
    """
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}")
                       for i, c in enumerate(columns)]).dropna()
    k = len(columns)
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)],
                    *[F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}_{j}")
                      for i in range(k) for j in range(i, k)])


def linear_regression(df: DataFrame, y: str, x: str | list[str]) -> dict:
    """Least squares with an intercept: R², adjusted R², coefficients and p-values."""
    x = [x] if isinstance(x, str) else list(x)
    require_columns(df, y, *x)
    row = cross_products(df, [*x, y]).first()
    n, k = row["n"], len(x)
    if n <= k + 1:
        raise ValueError("not enough complete rows for the regression")
    s = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    means = np.array([row[f"m{i}"] for i in range(k + 1)])
    inverse = np.linalg.pinv(s[:k, :k])
    beta = inverse @ s[:k, k]
    intercept = float(means[k] - beta @ means[:k])
    explained = float(beta @ s[:k, k] / s[k, k]) if s[k, k] > 0 else 0.0
    dof = n - k - 1
    noise = max(0.0, (s[k, k] - float(beta @ s[:k, k])) * n / dof)
    errors = [math.sqrt(noise * (1.0 / n + float(means[:k] @ inverse @ means[:k]) / n))]
    errors += [math.sqrt(max(0.0, noise * inverse[i, i] / n)) for i in range(k)]
    coefficients = {}
    for name, value, error in zip(["const", *x], [intercept, *beta], errors):
        t = float(value) / error if error > 0 else math.inf
        coefficients[name] = {"coef": float(value), "p_value": student_two_sided(t, dof)}
    return {"test": "ols_regression", "r_squared": explained,
            "adj_r_squared": 1 - (1 - explained) * (n - 1) / dof, "n": n,
            "coefficients": coefficients}


def statistical_test(df: DataFrame, test: str, **params) -> dict:
    tests = {"ttest": lambda p: welch_ttest(df, p["value_column"], p["group_column"], p.get("groups")),
             "chi_square": lambda p: chi_square(df, p["column_a"], p["column_b"]),
             "correlation": lambda p: pearson(df, p["column_a"], p["column_b"]),
             "linear_regression": lambda p: linear_regression(df, p["y_column"], p["x_columns"])}
    if test not in tests:
        raise ValueError(f"Unknown test. Use one of {sorted(tests)}")
    return tests[test](params)
