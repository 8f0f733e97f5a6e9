"""Quantiles, p-values, contributions, change points and tests against known values."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import scenarios
from inquest.functions.distributions import chi_square_upper, student_two_sided
from inquest.functions.quantiles import grouped_quantiles
from inquest.operators import (anomalies, changepoints, contribution, drivers, filters, stattests,
                               summaries)


def test_p_values_match_published_tables():
    assert student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert student_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert student_two_sided(0.0, 7) == pytest.approx(1.0)
    assert chi_square_upper(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert chi_square_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert chi_square_upper(124.342, 100) == pytest.approx(0.05, abs=1e-4)


@pytest.mark.parametrize("n", [1, 2, 7, 999, 12_000])
def test_narrowed_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b"], n))
    v = np.where(g == "hot", np.round(rng.normal(0, 1, n), 1), rng.lognormal(0, 2, n))
    probs = [0.0, 0.1, 0.25, 0.5, 0.67, 0.99, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    found = {r["g"]: r["q"] for r in grouped_quantiles(df, ["g"], "v", probs, buffered_rows=0).collect()}
    for name in set(g):
        assert found[name] == pytest.approx(np.quantile(v[g == name], probs), rel=1e-9, abs=1e-12)


def test_narrowed_quantiles_with_one_repeated_value(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.when(F.col("id") < 15_000, 5.0)
                                    .otherwise(F.col("id").cast("double")).alias("v"))
    q = grouped_quantiles(df, ["g"], "v", [0.5, 0.9], buffered_rows=0).first()["q"]
    v = np.where(np.arange(20_000) < 15_000, 5.0, np.arange(20_000))
    assert q == pytest.approx(np.quantile(v, [0.5, 0.9]))


def test_groups_keep_missing_keys_and_sort(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0), ("a", 2.0)], "k string, v double")
    rows = summaries.groupby_aggregate(df, "k", "v").collect()
    assert [(r["group"], r["value"], r["share_pct"]) for r in rows] == [("nan", 5.0, 62.5), ("a", 3.0, 37.5)]


def test_resampling_includes_empty_periods(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0), ("2024-03-09", 4.0), ("bad", 9.0)], "d string, v double")
    s = summaries.time_series(df, "d", "v").collect()
    assert [(str(r["period"]), r["value"]) for r in s] == [
        ("2024-01-31", 1.0), ("2024-02-29", 0.0), ("2024-03-31", 4.0)]
    assert summaries.time_series(df, "d", "v", agg="mean").collect()[1]["value"] is None


def test_unknown_operations_are_refused(spark):
    with pytest.raises(ValueError):
        filters.check_operation("exec")
    with pytest.raises(ValueError):
        summaries.aggregate("product", F.col("v"))
    for sql in ("DROP TABLE data", "select 1; delete from data", "with x as (select 1) update data set a = 1"):
        with pytest.raises(ValueError):
            filters.guard_sql(sql)


def test_small_group_can_drive_the_change(spark):
    rows = [(m, "Big", 1000.0) for m in scenarios.months("2024-01-01", "2024-12-01")]
    rows += [(m, "Small", 10.0 if m.month >= 10 else 100.0) for m in scenarios.months("2024-01-01", "2024-12-01")]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["d", "g", "v"]))
    top = contribution.period_contribution(df, "d", "v", "g").first()
    assert (top["group"], top["direction"]) == ("Small", "decline")
    assert top["contribution_to_total_change_pct"] > 90


def test_contribution_splits_and_interval(spark):
    pdf = scenarios.regional_decline()
    df = spark.createDataFrame(pdf)
    split = contribution.resolve_split(df, "date", "revenue")
    assert (split.date, split.method) == ("2024-07-01", "detected")
    by_hand = pdf.assign(late=pdf["date"] >= "2024-07-01").groupby(["region", "late"])["revenue"].sum().unstack()
    change = by_hand[True] / 3 - by_hand[False] / 18
    rows = {r["group"]: r for r in contribution.period_contribution(df, "date", "revenue", "region").collect()}
    for g, c in change.items():
        assert rows[g]["change"] == pytest.approx(c, abs=0.01)
        assert rows[g]["contribution_to_total_change_pct"] == pytest.approx(c / change.sum() * 100, abs=0.01)
    ci = contribution.contribution_intervals(df, "date", "revenue", "region", split)
    one = {r["group"]: (r["low"], r["high"]) for r in ci.collect()}
    again = {r["group"]: (r["low"], r["high"]) for r in contribution.contribution_intervals(
        df.repartition(7).orderBy(F.rand(3)), "date", "revenue", "region", split).collect()}
    assert one == again
    share = rows["South"]["contribution_to_total_change_pct"]
    assert one["South"][0] < share < one["South"][1]


def test_interval_matches_plain_resampling(spark):
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({"d": rng.choice(scenarios.months("2023-01-01", "2024-12-01"), n),
                        "g": rng.choice(["a", "b", "c"], n), "v": rng.normal(100, 20, n).round(1)})
    pdf.loc[(pdf["g"] == "a") & (pdf["d"] >= "2024-01-01"), "v"] -= 40
    df = spark.createDataFrame(pdf)
    split = contribution.resolve_split(df, "d", "v", "2024-01-01")
    got = contribution.contribution_intervals(df, "d", "v", "g", split, draws=400).where("`group` = 'a'").first()
    b, a = pdf[pdf["d"] < "2024-01-01"], pdf[pdf["d"] >= "2024-01-01"]
    shares = []
    for _ in range(1500):
        x, y = b.sample(len(b), replace=True, random_state=rng), a.sample(len(a), replace=True, random_state=rng)
        total = y["v"].sum() / 12 - x["v"].sum() / 12
        shares.append((y.loc[y["g"] == "a", "v"].sum() / 12 - x.loc[x["g"] == "a", "v"].sum() / 12) / total * 100)
    low, high = np.percentile(shares, [2.5, 97.5])
    width = high - low
    assert got["low"] == pytest.approx(low, abs=0.3 * width)
    assert got["high"] == pytest.approx(high, abs=0.3 * width)


def test_poisson_weights_have_the_right_mean_and_spread():
    keys = np.arange(4000, dtype=np.int64) * 7919
    for c in (1, 5, 40, 100):
        w = contribution.poisson_weights(keys, np.full(4000, c), 50)
        assert w.mean() == pytest.approx(c, rel=0.02)
        assert w.var() == pytest.approx(c, rel=0.06)


def test_refinement_names_the_pair(spark):
    df = spark.createDataFrame(scenarios.pair_decline())
    top = contribution.interaction_contribution(df, "date", "revenue", ["region", "product"]).first()
    assert top["worth_reporting"] and top["refined_to"] == "North × Widget"


def test_change_point_rules(spark):
    def found(values):
        rows = [(d.date(), float(v)) for d, v in zip(pd.date_range("2022-01-01", periods=len(values), freq="MS"), values)]
        r = changepoints.change_points(spark.createDataFrame(rows, "period date, value double")).first()
        return r["change_period"], r["strength"]
    step = [100.0 + (i % 3) for i in range(12)] + [40.0 + (i % 3) for i in range(6)]
    assert found(step)[0] == dt.date(2023, 1, 1) and found(step)[1] > 0.9
    assert found([100 - 3 * i for i in range(20)])[0] is None
    assert found([1, 2, 3])[0] is None
    assert found([5.0] * 12) == (None, 0.0)


def test_trend_reversal(spark):
    up_down = list(range(18)) + list(range(18, 0, -1))
    for values, expected in ((up_down, True), (list(range(36)), False)):
        rows = [(d.date(), float(v)) for d, v in zip(pd.date_range("2021-01-01", periods=36, freq="MS"), values)]
        df = spark.createDataFrame(rows, "period date, value double")
        assert changepoints.trend_reverses(df).first()["trend_change"] is expected


def test_welch_chi_square_and_regression(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": ["a"] * 60 + ["b"] * 60,
                        "v": np.r_[rng.normal(10, 1, 60), rng.normal(15, 1, 60)]})
    t = stattests.welch_ttest(spark.createDataFrame(pdf), "v", "g")
    assert t["significant"] and abs(t["cohens_d"]) > 0.8 and t["effect_size"] == "large"
    # 2x2 table 10, 20, 30, 40 corrected for continuity; and one with an empty cell
    cells = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 40
    c = stattests.chi_square(spark.createDataFrame(cells, "a string, b string"), "a", "b")
    assert c["statistic"] == pytest.approx(0.4464286, abs=1e-6) and c["dof"] == 1
    assert c["p_value"] == pytest.approx(0.5040359, abs=1e-5)
    empty = [("x", "p")] * 12 + [("y", "p")] * 5 + [("y", "q")] * 9
    e = stattests.chi_square(spark.createDataFrame(empty, "a string, b string"), "a", "b")
    table = np.array([[12, 0], [5, 9]], dtype=float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    gap = np.abs(table - expected)
    assert e["statistic"] == pytest.approx(((gap - np.minimum(0.5, gap)) ** 2 / expected).sum())
    x = rng.normal(0, 1, (200, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(0, 0.5, 200)
    m = stattests.linear_regression(spark.createDataFrame(
        pd.DataFrame({"y": y, "x1": x[:, 0], "x2": x[:, 1]})), "y", ["x1", "x2"])
    design = np.column_stack([np.ones(200), x])
    beta, ss, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert [c["coef"] for c in m["coefficients"].values()] == pytest.approx(beta)
    assert m["r_squared"] == pytest.approx(1 - ss[0] / ((y - y.mean()) ** 2).sum())
    assert all(c["p_value"] < 1e-6 for c in m["coefficients"].values())


def test_driver_rules(spark):
    fields = ("dimension string, `group` string, previous_per_period double, current_per_period double, "
              "change double, change_pct double, contribution_to_total_change_pct double, direction string, "
              "total_change_per_period double, total_change_pct double, groups long")
    def verdict(share, total_pct, groups):
        row = ("d", "g", 1.0, 1.0, -1.0, -1.0, share, "decline", -1.0, total_pct, groups)
        return drivers.driver_tests(spark.createDataFrame([row], fields)).first()["supported"]
    assert verdict(90.0, -20.0, 4)
    assert not verdict(90.0, -4.0, 4)
    assert not verdict(160.0, -20.0, 4)
    assert not verdict(35.0, -20.0, 4)


def test_odd_rows_are_flagged_under_any_partitioning(spark):
    rng = np.random.default_rng(7)
    quiet = pd.DataFrame({"a": rng.normal(500, 50, 300), "b": rng.integers(1, 20, 300).astype(float)})
    assert anomalies.anomalous_rows(spark.createDataFrame(quiet)) == 0
    loud = pd.concat([quiet, pd.DataFrame({"a": [9000.0], "b": [1.0]})], ignore_index=True)
    df = spark.createDataFrame(loud)
    assert anomalies.anomalous_rows(df) == anomalies.anomalous_rows(df.repartition(7)) == 1


def test_extreme_value_among_equal_ones(spark):
    df = spark.createDataFrame([(10.0,)] * 40 + [(9000.0,)], "v double")
    r = anomalies.outlier_counts(df).first()
    assert (r["outliers"], r["extreme_outliers"]) == (0, 1)


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    import math
    from inquest.functions.exactsums import exact_sum
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(0, 10.0 ** k, 300) for k in range(-9, 16)]).tolist()
    values += [-v for v in values[:4000]] + [1e15, 0.1, 0.2, -1e15, 3e27, -3e27]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    sums = {df.repartition(n).agg(exact_sum(F.col("v"))).first()[0] for n in (1, 3, 8)}
    sums |= {df.orderBy(order).agg(exact_sum(F.col("v"))).first()[0] for order in ("v", F.desc("v"))}
    assert len(sums) == 1
    assert sums.pop() == pytest.approx(math.fsum(values), rel=1e-12)
    for some in ([-0.22, -0.55, -1118.43, 0.1], [-1e-9, -3.25], [5.5, -5.5], [-1e15, 0.3], [7.0, -8.125]):
        one = spark.createDataFrame([(v,) for v in some], "v double").agg(exact_sum(F.col("v"))).first()[0]
        assert one == pytest.approx(math.fsum(some), rel=1e-15, abs=1e-17)
    few = spark.createDataFrame([(0.1,)] * 10, "v double")
    assert few.agg(exact_sum(F.col("v"))).first()[0] == pytest.approx(1.0, rel=1e-15)
    odd = spark.createDataFrame([(float("inf"),), (1.0,)], "v double")
    assert odd.agg(exact_sum(F.col("v"))).first()[0] == float("inf")
    assert df.where("v > 1e30").agg(exact_sum(F.col("v"))).first()[0] is None


def test_results_show_a_changed_ninth_digit(spark):
    from inquest.plans.tools import checksum, frame_result
    from inquest.operators.summaries import groupby_aggregate
    rows = [(f"g{i % 700}", 1e15 / 7 + i * 0.37) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    marks = {checksum(frame_result(groupby_aggregate(df.repartition(n), "g", "v"))) for n in (1, 5, 8)}
    assert len(marks) == 1
    other = df.withColumn("v", F.when(F.col("g") == "g650", F.col("v") * (1 + 2e-8)).otherwise(F.col("v")))
    assert checksum(frame_result(groupby_aggregate(other, "g", "v"))) not in marks


def test_intervals_count_keys_in_more_tasks(spark):
    rng = np.random.default_rng(8)
    n = 2000
    pdf = pd.DataFrame({"d": rng.choice(scenarios.months("2023-01-01", "2024-12-01"), n),
                        "g": rng.choice(["a", "b", None], n), "h": rng.choice([1, 2], n),
                        "v": np.where(rng.random(n) < 0.3, 0.0, rng.normal(100, 20, n).round(1))})
    df = spark.createDataFrame(pdf)
    split = contribution.resolve_split(df, "d", "v", "2024-01-01")
    few, many = (contribution.contribution_intervals(df, "d", "v", ["g", "h"], split, **kw) for kw in (
        {}, {"keys_per_task": 200}))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 4
    rows = df.select(F.lit(True).alias("late"), F.col("v").alias("m"), "g", "h")
    counted = contribution._counted(rows, ["g", "h"], 4, 40)
    assert counted.rdd.getNumPartitions() == 40 and counted.agg(F.sum("c")).first()[0] == 2 * n
    assert counted.where("m = 0 AND dimension = 'h'").count() == 2
