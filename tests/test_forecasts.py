"""Series models, gates and holdout scores."""

import numpy as np
import pandas as pd
import pytest

from inquest.functions import seriesmodels as sm
from inquest.operators import forecasting


def frame(spark, values, key=None):
    periods = pd.date_range("2021-01-31", periods=len(values), freq="ME")
    rows = [(key, p.date(), float(v)) for p, v in zip(periods, values)]
    return spark.createDataFrame(rows, "k string, period date, value double")


def test_short_series_are_withheld_and_bands_ordered(spark):
    rng = np.random.default_rng(0)
    short = frame(spark, [1, 2, 3, 4], "short")
    long = frame(spark, 100 + 5 * np.arange(36) + rng.normal(0, 2, 36), "long")
    got = {r["k"]: r for r in forecasting.forecast(short.unionByName(long), ["k"]).collect()}
    assert got["short"]["reliability"] == "withheld_insufficient_data" and got["short"]["predictions"] == []
    assert got["long"]["folds"] == 3
    for p in got["long"]["predictions"]:
        assert p["lower"] <= p["point"] <= p["upper"]
    assert [p["period"] for p in got["long"]["predictions"]] == ["2024-01-31", "2024-02-29", "2024-03-31"]


@pytest.mark.parametrize("n,external,expected", [(6, False, "insufficient"), (15, False, "ets"), (40, False, "sarima"),
                                                 (16, True, "gbr"), (15, True, "ets"), (40, True, "gbr")])
def test_model_choice(spark, n, external, expected):
    r = forecasting.choose_models(frame(spark, range(n)), ["k"], "M", external).first()
    assert r["model"] == expected
    assert forecasting.choose_models(frame(spark, range(40)), ["k"], "W").first()["model"] == "arima"


def test_models_follow_their_patterns():
    t = np.arange(60)
    line = 50 + 3.0 * t
    assert sm.fit("ets", line, 3)[0] == pytest.approx(50 + 3 * np.array([60, 61, 62]), rel=1e-3)
    season = 100 + 20 * np.sin(2 * np.pi * t / 12) + t
    assert sm.fit("sarima", season, 12, 12)[0] == pytest.approx(
        100 + 20 * np.sin(2 * np.pi * np.arange(60, 72) / 12) + np.arange(60, 72), abs=1.0)
    rng = np.random.default_rng(1)
    walk = np.cumsum(rng.normal(0, 1, 300)) + 100
    points, low, high = sm.fit("arima", walk, 4)
    assert np.all(np.diff(high - low) > 0)


def test_autoregressive_changes_beat_the_last_value():
    rng = np.random.default_rng(3)
    d = np.zeros(400)
    for i in range(1, 400):
        d[i] = 0.8 * d[i - 1] + rng.normal()
    y = np.cumsum(d) + 500
    mine = [abs(sm.fit("arima", y[:i], 1)[0][0] - y[i]) for i in range(350, 400)]
    last = [abs(y[i - 1] - y[i]) for i in range(350, 400)]
    assert np.mean(mine) < 0.8 * np.mean(last)


def test_boosting_uses_external_values(spark):
    rng = np.random.default_rng(5)
    dates = pd.date_range("2022-01-01", periods=30, freq="MS")
    price = rng.uniform(50, 150, 30)
    df = spark.createDataFrame(pd.DataFrame({"date": dates, "revenue": 10_000 - 40 * price + rng.normal(0, 50, 30), "price": price}))
    r = forecasting.run_forecast(df, "date", "revenue").first()
    assert r["model_name"] == "gbr"
    p = r["predictions"][0]
    assert (p["upper"] - p["lower"]) / abs(p["point"]) > 0.001


def test_boosted_trees_fit_a_step():
    x = np.linspace(0, 1, 80)[:, None]
    y = np.where(x[:, 0] > 0.5, 10.0, 2.0)
    assert sm.boosted(x, y)(np.array([[0.1], [0.9]])) == pytest.approx([2.0, 10.0], abs=0.01)


def test_external_gaps_are_filled_from_both_sides(spark):
    series = frame(spark, [1, 2, 3, 4]).drop("k")
    side = spark.createDataFrame([("2021-02-10", 5.0), ("2021-02-20", 7.0)], "d string, x double")
    got = [r["x"] for r in forecasting.align_external(series, side, "d", ["x"]).orderBy("period").collect()]
    assert got == [6.0, 6.0, 6.0, 6.0]


def test_holdout_scores(spark):
    actual = spark.createDataFrame([("2024-01-01", 100.0), ("2024-02-01", 110.0)], "period string, actual double")
    guess = spark.createDataFrame([(1, 102.0, 95.0, 109.0), (2, 108.0, 100.0, 116.0)],
                                  "step int, point double, lower double, upper double")
    r = forecasting.holdout_score(actual, guess).first()
    assert (r["holdout_rmse"], r["interval_coverage"], r["holdout_periods"]) == (2.0, 1.0, 2)


def test_tail_is_withheld_only_from_long_tables(spark):
    for n, held in ((15, 0), (16, 3)):
        pdf = pd.DataFrame({"d": pd.date_range("2023-01-01", periods=n, freq="MS"), "v": np.arange(n) * 1.0})
        kept, tail = forecasting.withhold_tail(spark.createDataFrame(pdf), "d", "v")
        assert (kept.count(), tail.count()) == (n - held, held)
