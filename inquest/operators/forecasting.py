"""Forecasts of many series at once, shown only as far as a backtest supports them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from inquest.constants import (MAX_ACCEPTABLE_MAPE, MIN_SERIES_FOR_SEASONAL, MIN_SERIES_LENGTH,
                               SEASON_LENGTH)
from inquest.functions import seriesmodels as sm
from inquest.functions.dates import (later_label, parsed_column, period_label, period_start)
from inquest.functions.tables import numeric_columns
from inquest.operators.filters import where_equal
from inquest.operators.summaries import build_series

FOLDS, MIN_TRAIN, MIN_BOOSTED, MAX_EXTERNAL = 3, MIN_SERIES_LENGTH - 2, 16, 4


def model_for(n: Column, seasonal: Column, external: Column) -> Column:
    """The model a series' length and side data allow."""
    return (F.when(n < MIN_SERIES_LENGTH, "insufficient")
            .when((n < MIN_SERIES_FOR_SEASONAL) & external & (n >= MIN_BOOSTED), "gbr")
            .when(n < MIN_SERIES_FOR_SEASONAL, "ets")
            .when(external, "gbr").when(seasonal, "sarima").otherwise("arima"))


def choose_models(series: DataFrame, keys: list[str] = (), freq: str = "M",
                  has_external: bool = False) -> DataFrame:
    """``n`` and ``model`` per series."""
    per = series.groupBy(*keys).agg(F.count("value").alias("n"), F.max("period").alias("last_period"))
    n = F.col("n")
    return per.withColumn("model", model_for(n, n >= 2 * SEASON_LENGTH.get(freq, 12),
                                             F.lit(has_external)))


def lag_features(series: DataFrame, keys: list[str] = (), exog: list[str] = ()) -> DataFrame:
    """Three lags and their mean, with the external values of the same period."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("period")
    return (series.select(
        *keys, "period", F.col("value").alias("target"),
        F.lag("value", 3).over(w).alias("lag_3"), F.lag("value", 2).over(w).alias("lag_2"),
        F.lag("value", 1).over(w).alias("lag_1"),
        F.avg("value").over(w.rowsBetween(-3, -1)).alias("lag_mean"), *exog)
        .where("lag_3 IS NOT NULL"))


def simple_forecasts(series: DataFrame, keys: list[str] = (), horizon: int = 3) -> DataFrame:
    """Last value and three-value mean with their bands: one row per model and step."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("period")
    stepped = series.select(*keys, "period", "value",
                            (F.col("value") - F.lag("value").over(w)).alias("d"),
                            F.row_number().over(w.orderBy(F.desc("period"))).alias("back"))
    recent = F.when(F.col("back") <= 3, F.col("value"))
    per = stepped.groupBy(*keys).agg(
        F.count("value").alias("n"), F.max_by("value", "period").alias("last"),
        F.stddev_pop("d").alias("spread"), F.avg(recent).alias("mean"),
        F.stddev_pop(recent).alias("wobble"))
    models = F.array(
        F.struct(F.lit("naive").alias("model"), F.col("last").alias("point"),
                 F.when(F.col("n") > 2, F.col("spread")).otherwise(0.0).alias("s")),
        F.struct(F.lit("moving_average").alias("model"), F.col("mean").alias("point"),
                 F.coalesce("wobble", F.lit(0.0)).alias("s")))
    rows = per.select(*keys, F.explode(models).alias("m")).select(
        *keys, "m.*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    margin = F.lit(sm.BAND) * F.col("s") * F.sqrt("step")
    return rows.select(*keys, "model", "step", "point", (F.col("point") - margin).alias("lower"),
                       (F.col("point") + margin).alias("upper"))


def align_external(series: DataFrame, df: DataFrame, date: str, columns: list[str], freq: str = "M",
                   keys: list[str] = ()) -> DataFrame:
    """Means of other columns on the series' periods; gaps take the last, then the next value."""
    keys = list(keys)
    start = period_start(parsed_column(df, date), freq)
    means = (df.select(*[F.col(f"`{k}`") for k in keys],
                       period_label(start, freq).alias("period"),
                       *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
             .where("period IS NOT NULL").groupBy(*keys, "period")
             .agg(*[F.avg(f"`{c}`").alias(c) for c in columns]))
    joined = series.join(means, [*keys, "period"], "left")
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("period")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.last(f"`{c}`", ignorenulls=True).over(back),
                                                 F.first(f"`{c}`", ignorenulls=True).over(ahead)))
    return joined


def _fit_series(keys: list[str], exog: list[str], horizon: int, period: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period", kind="stable")
        y = pdf["value"].to_numpy(dtype=float)
        x = pdf[exog].to_numpy(dtype=float) if exog else None
        if x is not None and not np.isfinite(x).all():
            x = np.nan_to_num(x)
        row = {k: pdf[k].iloc[0] for k in keys} | {
            "model_name": None, "folds": 0, "mape": None, "naive_mape": None, "points": []}
        for name in dict.fromkeys([pdf["model"].iloc[0], "ets", "moving_average"]):
            try:
                parts = sm.fit(name, y, horizon, period, x)
            except (ValueError, np.linalg.LinAlgError, FloatingPointError):
                continue
            row["model_name"] = name
            row["points"] = [{"step": i + 1, "point": round(float(p), 2), "lower": round(float(lo), 2),
                              "upper": round(float(up), 2)}
                             for i, (p, lo, up) in enumerate(zip(*parts))]
            break
        errors = []
        for back in range(FOLDS, 0, -1):
            cut = len(y) - back
            if cut < MIN_TRAIN:
                continue
            train_x = x[:cut] if x is not None and row["model_name"] == "gbr" else None
            try:
                guess = sm.fit(row["model_name"], y[:cut], 1, period, train_x, banded=False)[0]
            except (ValueError, np.linalg.LinAlgError, FloatingPointError):
                continue
            test = y[cut:cut + 1]
            errors.append((sm.percentage_error(test, guess),
                           sm.percentage_error(test, np.array([y[cut - 1]]))))
        if errors:
            row |= {"folds": len(errors), "mape": float(np.mean([e[0] for e in errors])),
                    "naive_mape": float(np.mean([e[1] for e in errors]))}
        return pd.DataFrame([row])
    return run


def forecast(series: DataFrame, keys: list[str] = (), horizon: int = 3, freq: str = "M",
             exog: list[str] = ()) -> DataFrame:
    """One row per series: model, reliability, backtest errors and banded predictions.

    A series has one row per calendar period, so a task never holds more than that;
    the number of series is what grows, and they are spread over the cluster.
    """
    keys, exog = list(keys), list(exog)
    if exog and series.where(F.coalesce(*[F.col(f"`{c}`") for c in exog], F.lit(None))
                             .isNotNull()).isEmpty():
        exog = []
    chosen = choose_models(series, keys, freq, bool(exog))
    if not keys:
        series, chosen = series.withColumn("key_", F.lit(0)), chosen.withColumn("key_", F.lit(0))
    ids = keys or ["key_"]
    fitted_rows = (series.select(*ids, "period", "value", *exog)
                   .join(chosen.where("model <> 'insufficient'").select(*ids, "model"), ids))
    types = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in ids] + [
        "model_name string", "folds int", "mape double", "naive_mape double",
        "points array<struct<step:int,point:double,lower:double,upper:double>>"])
    fitted = fitted_rows.groupBy(*ids).applyInPandas(
        _fit_series(ids, exog, horizon, SEASON_LENGTH.get(freq, 12)), schema)
    out = chosen.join(fitted, ids, "left")
    short = F.col("model") == "insufficient"
    beats = F.col("mape") < F.col("naive_mape")
    mape = F.round("mape", 2)
    return out.select(
        *keys, F.col("n").alias("series_length"),
        F.when(short, "none").otherwise(F.col("model_name")).alias("model_name"),
        F.when(short, "withheld_insufficient_data")
        .when(F.col("mape").isNull() | (mape > MAX_ACCEPTABLE_MAPE) | ~beats, "low_confidence")
        .otherwise("ok").alias("reliability"),
        F.when(short, F.concat(F.lit("only "), "n", F.lit(f" periods; {MIN_SERIES_LENGTH} are needed")))
        .when(F.col("mape").isNull(), "not enough history to backtest")
        .when(mape > MAX_ACCEPTABLE_MAPE,
              F.concat(F.lit("backtest error "), mape.cast("string"), F.lit("% is too large")))
        .when(~beats, "no better than the last value").alias("withheld_reason"),
        F.coalesce("folds", F.lit(0)).alias("folds"), mape.alias("mape"),
        F.round("naive_mape", 2).alias("naive_mape"), beats.alias("beats_naive"),
        F.coalesce(F.transform("points", lambda p: F.struct(
            later_label(F.col("last_period"), p["step"], freq).cast("string").alias("period"),
            p["point"].alias("point"), p["lower"].alias("lower"), p["upper"].alias("upper"))),
            F.array().cast("array<struct<period:string,point:double,lower:double,upper:double>>"))
        .alias("predictions"))


def run_forecast(df: DataFrame, date: str, metric: str, horizon: int = 3, freq: str = "M",
                 agg: str = "sum", filters: dict | None = None, by: list[str] = (),
                 external: list[str] | None = None, use_external: bool = True) -> DataFrame:
    """Forecast a metric, or the metric of every group of ``by``.

    Up to four other numeric columns serve as external features.
    """
    df = where_equal(df, filters)
    series = build_series(df, date, metric, freq, agg, by)
    used = []
    if use_external:
        used = [c for c in (external or numeric_columns(df))
                if c in df.columns and c != metric and c not in by][:MAX_EXTERNAL]
        if used:
            series = align_external(series, df, date, used, freq, by)
    return forecast(series, list(by), horizon, freq, used)


def predictions_frame(forecasts: DataFrame, keys: list[str] = ()) -> DataFrame:
    return forecasts.select(*keys, F.posexplode("predictions").alias("step", "p")).select(
        *keys, (F.col("step") + 1).alias("step"), "p.*")


def chart_frame(series: DataFrame, forecasts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """History and projection below each other, for a picture."""
    none = F.lit(None).cast("double")
    past = series.select(*keys, F.col("period").cast("string").alias("period"),
                         F.lit("actual").alias("part"), F.col("value").alias("point"),
                         none.alias("lower"), none.alias("upper"))
    ahead = predictions_frame(forecasts, keys).select(
        *keys, "period", F.lit("forecast").alias("part"), "point", "lower", "upper")
    return past.unionByName(ahead)


def withhold_tail(df: DataFrame, date: str, metric: str,
                  periods: int = 3) -> tuple[DataFrame, DataFrame]:
    """The table without its last months, and those months' totals.

    With no more than 15 months nothing is held back.
    """
    ts = parsed_column(df, date)
    months = (df.where(ts.isNotNull()).groupBy(F.trunc(ts, "month").alias("period"))
              .agg(F.coalesce(F.sum(f"`{metric}`"), F.lit(0)).cast("double").alias("actual")))
    rank = Window.orderBy(F.desc("period"))  # one row per calendar month
    ranked = months.withColumn("k_", F.row_number().over(rank)).withColumn(
        "n_", F.count(F.lit(1)).over(Window.partitionBy()))
    held = ranked.where((F.col("k_") <= periods) & (F.col("n_") > periods + 12)).select(
        "period", F.round("actual", 2).alias("actual"))
    first = held.agg(F.min("period").alias("cut")).first()["cut"]
    kept = df if first is None else df.where(
        ts.isNull() | (ts < F.lit(str(first)).cast("timestamp")))
    return kept, held


def holdout_score(actuals: DataFrame, predictions: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Errors of a forecast on withheld periods, against repeating the first of them."""
    keys = list(keys)
    first = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("period")
    a = actuals.select(*keys, F.row_number().over(first).alias("step"), "actual",
                       F.first("actual").over(first).alias("naive"))
    both = a.join(predictions.select(*keys, "step", "point", "lower", "upper"), [*keys, "step"])
    err, nerr = F.col("actual") - F.col("point"), F.col("actual") - F.col("naive")
    used = F.col("actual") != 0
    mape = F.round(F.avg(F.when(used, F.abs(err) / F.col("actual") * 100)), 2)
    naive = F.round(F.avg(F.when(used, F.abs(nerr) / F.col("actual") * 100)), 2)
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("holdout_periods"), mape.alias("holdout_mape"),
        naive.alias("holdout_naive_mape"), F.round(F.sqrt(F.avg(err * err)), 2).alias("holdout_rmse"),
        F.round(F.sqrt(F.avg(nerr * nerr)), 2).alias("holdout_naive_rmse"),
        F.round(F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")), 3)
        .alias("interval_coverage"),
    ).withColumn("beats_naive", F.coalesce(F.col("holdout_mape") < F.col("holdout_naive_mape"),
                                           F.lit(False)))
