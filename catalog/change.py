"""Contribution, change points, statistical tests, joins and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import load, query
from inquest.operators import (changepoints, contribution, drift, drivers, driversearch, joining, stattests,
                               summaries)

CONTRIBUTION = """
  months AS (SELECT count(DISTINCT date_trunc('month', {date})) FILTER ({date} < TIMESTAMP '{split}') AS pm,
                    count(DISTINCT date_trunc('month', {date})) FILTER ({date} >= TIMESTAMP '{split}') AS cm
             FROM {table}),
  sums AS ({sums}),
  per AS (SELECT dimension, "group", b / pm AS prev, a / cm AS curr, a / cm - b / pm AS change FROM sums, months),
  tot AS (SELECT dimension, sum(change) AS total, sum(prev) AS total_prev, count(*) AS groups FROM per GROUP BY 1),
  contribution AS (
  SELECT per.dimension, "group", round(prev, 2) AS previous_per_period, round(curr, 2) AS current_per_period,
    round(change, 2) AS change, round(change / nullif(prev, 0) * 100, 2) AS change_pct,
    round(CASE WHEN total = 0 THEN 0 ELSE change / total * 100 END, 2) + 0 AS contribution_to_total_change_pct,
    CASE WHEN total < 0 THEN 'decline' ELSE 'increase' END AS direction,
    round(total, 2) AS total_change_per_period,
    round(total / nullif(total_prev, 0) * 100, 2) AS total_change_pct, groups
  FROM per JOIN tot USING (dimension))"""
SUM = """SELECT '{dim}' AS dimension, {dim}::VARCHAR AS "group",
  coalesce(sum({metric}) FILTER ({date} < TIMESTAMP '{split}'), 0) AS b,
  coalesce(sum({metric}) FILTER ({date} >= TIMESTAMP '{split}'), 0) AS a FROM {table}
  WHERE {dim} IS NOT NULL GROUP BY {dim}"""
COLUMNS = ["dimension", "group", "previous_per_period", "current_per_period", "change", "change_pct",
           "contribution_to_total_change_pct", "direction", "total_change_per_period",
           "total_change_pct", "groups"]
LIST = ", ".join(f'"{c}"' for c in COLUMNS)


def contribution_sql(table, date, metric, dims, split):
    sums = " UNION ALL ".join(SUM.format(dim=d, metric=metric, date=date, split=split, table=table)
                              for d in dims)
    return CONTRIBUTION.format(date=date, split=split, table=table, sums=sums)


LINE = contribution_sql("lineitem", "l_shipdate", "l_extendedprice", ["l_returnflag", "l_linestatus"],
                        "1998-10-15")


@query(f"WITH {LINE} SELECT {LIST} FROM contribution")
def period_contribution(spark, sf):
    return contribution.period_contribution(
        load(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", ["l_returnflag", "l_linestatus"],
        "1998-10-15").select(*COLUMNS)


@query("WITH " + contribution_sql("lineitem", "l_shipdate", "l_quantity", ["l_suppkey"], "2000-01-01")
       + f" SELECT {LIST} FROM contribution")
def period_contribution_many_groups(spark, sf):
    return contribution.period_contribution(load(spark, sf, "lineitem"), "l_shipdate", "l_quantity",
                                            "l_suppkey", "2000-01-01").select(*COLUMNS)


SEARCHED = ["l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]
PLANTED = {"driver_search": ("l_suppkey = 7", 40), "driver_search_pair":
           ("l_returnflag = 'R' AND l_linenumber = 2", 9)}


def search_sql(case, factor, split="1996-01-01"):
    """Every value and every pair of values, counted outright."""
    late, n = f"ts >= DATE '{split}'", len(SEARCHED)
    sets = [f"SELECT 1 AS level, '{d}' AS dimensions, d{i} AS groups, sum(c) AS c, sum(p) AS p FROM r GROUP BY d{i}"
            for i, d in enumerate(SEARCHED)]
    sets += [f"SELECT 2, '{SEARCHED[i]} × {SEARCHED[k]}', d{i} || ' × ' || d{k}, sum(c), sum(p) FROM r GROUP BY d{i}, d{k}"
             for i in range(n) for k in range(i + 1, n)]
    return f"""WITH t AS (SELECT l_shipdate AS ts, l_extendedprice * CASE WHEN {case} AND
         l_shipdate >= DATE '{split}' THEN {factor} ELSE 1 END AS m,
         {", ".join(f"{d}::VARCHAR AS d{i}" for i, d in enumerate(SEARCHED))} FROM lineitem),
       s AS (SELECT count(DISTINCT date_trunc('month', ts)) FILTER ({late}) AS late,
                    count(DISTINCT date_trunc('month', ts)) FILTER (NOT {late}) AS early FROM t),
       r AS (SELECT t.*, CASE WHEN {late} THEN m / late ELSE -m / early END AS c,
                    CASE WHEN {late} THEN 0 ELSE m / early END AS p FROM t, s),
       w AS (SELECT sum(c) AS wc, sum(p) AS wp FROM r), g AS ({" UNION ALL ".join(sets)})
       SELECT level, dimensions, groups, round(p, 2) AS previous_per_period,
         round(p + c, 2) AS current_per_period, round(c, 2) AS change, round(c / wc * 100, 2) AS share_pct,
         round(p / wp * 100, 2) AS base_pct, round(c / wc * 100 - p / wp * 100, 2) AS lift
       FROM g, w WHERE c / wc * 100 >= 20"""


def _planted(spark, sf, name):
    case, factor = PLANTED[name]
    rows = load(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") * F.when(
        F.expr(case) & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("date")), factor).otherwise(1))
    return driversearch.driver_search(rows, "l_shipdate", "price", SEARCHED, "1996-01-01")


@query(search_sql(*PLANTED["driver_search"]))
def driver_search(spark, sf):
    """One supplier of thousands sells more: found among all columns and pairs."""
    return _planted(spark, sf, "driver_search")


@query(search_sql(*PLANTED["driver_search_pair"]))
def driver_search_pair(spark, sf):
    """One line number of one return flag grows: the pair stands first."""
    return _planted(spark, sf, "driver_search_pair")


STEP = """
  m AS (SELECT date_trunc('month', {date})::DATE AS p, sum({metric}) AS v FROM {table} GROUP BY 1),
  s AS (SELECT unnest(generate_series((SELECT min(p) FROM m), (SELECT max(p) FROM m), INTERVAL 1 MONTH))::DATE AS p),
  y AS (SELECT p, coalesce(v, 0) AS v, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n
        FROM s LEFT JOIN m USING (p)),
  d AS (SELECT *, v - avg(v) OVER () AS d FROM y),
  pre AS (SELECT *, sum(d) OVER w AS ls, sum(d * d) OVER w AS lq, sum(d) OVER () AS ts, sum(d * d) OVER () AS tq
          FROM d WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c AS (SELECT p, i, n, tq, (lq - ls * ls / i) + ((tq - lq) - (ts - ls) * (ts - ls) / (n - i)) AS cost
        FROM pre WHERE i >= 2 AND i < n - 2),
  best AS (SELECT * FROM c ORDER BY cost, i LIMIT 1),
  line AS (SELECT regr_syy(d, i) - regr_sxy(d, i) ^ 2 / regr_sxx(d, i) AS cost FROM d),
  step AS (SELECT CASE WHEN line.cost > best.cost * 1.25 THEN strftime(p, '%Y-%m-%d') END AS change_period,
      round(CASE WHEN line.cost > best.cost * 1.25 THEN 1 - best.cost / tq ELSE 0 END, 6) AS strength
    FROM best, line)"""


@query("WITH " + STEP.format(date="o_orderdate", metric="o_totalprice", table="orders") + " SELECT * FROM step")
def change_point(spark, sf):
    series = summaries.period_values(load(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return changepoints.change_points(series).select(
        F.col("change_period").cast("string").alias("change_period"),
        F.round("strength", 6).alias("strength"))


@query("WITH " + STEP.format(date="l_shipdate", metric="l_extendedprice", table="lineitem") + """,
  q AS (SELECT quantile_cont(epoch_us(l_shipdate), 0.67) AS us FROM lineitem)
  SELECT CASE WHEN strength >= 0.25 THEN change_period
              ELSE strftime(make_timestamp(us::BIGINT), '%Y-%m-%d') END AS split_date,
         CASE WHEN strength >= 0.25 THEN 'detected' ELSE 'fallback' END AS split_method,
         round(strength, 3) AS split_strength FROM step, q""")
def default_split(spark, sf):
    return contribution.period_contribution(load(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice",
                                            "l_returnflag").select(
        "split_date", "split_method", "split_strength").distinct()


@query("""WITH m AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate) AS p,
     sum(o_totalprice) AS v FROM orders GROUP BY ALL),
  t AS (SELECT *, ntile(3) OVER (PARTITION BY k ORDER BY p) AS third,
     row_number() OVER (PARTITION BY k ORDER BY p) AS x FROM m),
  sl AS (SELECT k, third, regr_slope(v, x) AS slope FROM t GROUP BY ALL),
  sc AS (SELECT k, count(*) AS n, avg(abs(v)) AS scale FROM m GROUP BY k),
  st AS (SELECT k, n, list(sign(slope) ORDER BY third) FILTER (abs(slope) > 0.01 * scale) AS s
     FROM sl JOIN sc USING (k) GROUP BY k, n)
  SELECT k AS o_orderpriority, n, n >= 12 AND coalesce(len(s), 0) >= 2
     AND list_has_any([s[i] * s[i + 1] < 0 FOR i IN range(1, len(s))], [true]) AS trend_change FROM st""")
def trend_reversal(spark, sf):
    o = load(spark, sf, "orders").groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("period")
                                          ).agg(F.sum("o_totalprice").alias("value"))
    return changepoints.trend_reverses(o, ["o_orderpriority"])


INNER = """WITH {outer}, lead AS (SELECT "group" AS g, contribution_to_total_change_pct AS share, direction
     FROM contribution ORDER BY contribution_to_total_change_pct DESC, "group" LIMIT 1),
  inside AS (SELECT * FROM lineitem, lead WHERE l_returnflag = g),
  im AS (SELECT count(DISTINCT date_trunc('month', l_shipdate)) FILTER (l_shipdate < TIMESTAMP '{split}') AS pm,
                count(DISTINCT date_trunc('month', l_shipdate)) FILTER (l_shipdate >= TIMESTAMP '{split}') AS cm
         FROM inside),
  s AS (SELECT l_linestatus AS "group", coalesce(sum(l_extendedprice) FILTER (l_shipdate < TIMESTAMP '{split}'), 0) / any_value(pm) AS prev,
               coalesce(sum(l_extendedprice) FILTER (l_shipdate >= TIMESTAMP '{split}'), 0) / any_value(cm) AS curr
        FROM inside, im GROUP BY 1)
  SELECT g AS leading_group, share AS leading_group_share_pct, direction, "group", round(prev, 2) AS previous_per_period,
     round(curr, 2) AS current_per_period, round(curr - prev, 2) AS change,
     round((curr - prev) / sum(curr - prev) OVER () * 100, 2) AS contribution_to_total_change_pct,
     count(*) OVER () AS values_examined FROM s, lead"""


@query(INNER.format(outer=contribution_sql("lineitem", "l_shipdate", "l_extendedprice", ["l_returnflag"],
                                           "1998-10-15"), split="1998-10-15"))
def interaction_contribution(spark, sf):
    return contribution.interaction_contribution(
        load(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", ["l_returnflag", "l_linestatus"],
        "1998-10-15").select(
        "leading_group", "leading_group_share_pct", "direction", "group", "previous_per_period",
        "current_per_period", "change", "contribution_to_total_change_pct", "values_examined")


@query("""WITH m AS (SELECT l_returnflag AS k, date_trunc('month', l_shipdate)::DATE AS p, sum(l_extendedprice) AS v
     FROM lineitem GROUP BY ALL),
  r AS (SELECT k, min(p) AS lo, max(p) AS hi FROM m GROUP BY k),
  s AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS p FROM r),
  y AS (SELECT s.k, s.p, coalesce(v, 0) AS v FROM s LEFT JOIN m ON s.k = m.k AND s.p = m.p),
  j AS (SELECT a.k, count(*) AS months,
     count(*) FILTER (a.p >= DATE '1999-01-01' AND b.p IS NOT NULL) AS pairs,
     sum(b.v) FILTER (a.p >= DATE '1999-01-01') AS last,
     sum(a.v) FILTER (a.p >= DATE '1999-01-01' AND b.p IS NOT NULL) AS this
     FROM y a LEFT JOIN y b ON a.k = b.k AND b.p = a.p - INTERVAL 12 MONTH GROUP BY a.k)
  SELECT k AS "group", months, months >= 24 AND pairs >= 2 AS checked, pairs AS months_compared,
     round(last, 2) AS same_months_last_year, round(this, 2) AS same_months_this_year,
     round((this - last) / last * 100, 2) AS year_on_year_pct, (this - last) / last * 100 < -5 AS survives FROM j""")
def seasonal_check(spark, sf):
    return contribution.seasonal_check(load(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice",
                                       "l_returnflag", "1999-01-01").drop("dimension")


@query()
def contribution_intervals(spark, sf):
    rows = load(spark, sf, "lineitem")
    split = contribution.resolve_split(rows, "l_shipdate", "l_extendedprice", "1998-10-15")
    return contribution.contribution_intervals(rows, "l_shipdate", "l_extendedprice",
                                               ["l_returnflag", "l_linestatus"], split)


@query("""SELECT strftime(make_timestamp(quantile_cont(epoch_us(ts), 0.67)::BIGINT), '%Y-%m-%d') AS current_start,
   strftime(max(ts), '%Y-%m-%d') AS current_end, strftime(min(ts), '%Y-%m-%d') AS previous_start FROM events""")
def split_periods(spark, sf):
    out = contribution.split_periods(load(spark, sf, "events"), "ts")
    return out.select(*[F.col(c).cast("string").alias(c)
                        for c in ("current_start", "current_end", "previous_start")])


@query(f"""WITH {LINE}, r AS (SELECT *, row_number() OVER (PARTITION BY dimension
     ORDER BY contribution_to_total_change_pct DESC, "group") AS k FROM contribution)
  SELECT dimension, "group", contribution_to_total_change_pct AS share,
    abs(total_change_pct) >= 5 AND contribution_to_total_change_pct >= 100.0 / groups * 1.6
      AND contribution_to_total_change_pct <= 150 AS supported,
    CASE WHEN abs(total_change_pct) < 5 THEN 'the overall movement is too small'
      WHEN contribution_to_total_change_pct > 150 THEN 'groups moved in opposite directions and cancelled out'
      WHEN contribution_to_total_change_pct < 100.0 / groups * 1.6 THEN 'no group carries a disproportionate share'
      END AS reject_reason FROM r WHERE k = 1""")
def driver_tests(spark, sf):
    table = contribution.period_contribution(
        load(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", ["l_returnflag", "l_linestatus"],
        "1998-10-15")
    return drivers.driver_tests(table).select(
        "dimension", "group", F.col("contribution_to_total_change_pct").alias("share"), "supported",
        "reject_reason")


@query("""WITH g AS (SELECT c_mktsegment AS "group", sum(c_acctbal) AS v FROM customer GROUP BY 1),
   s AS (SELECT "group", round(v, 2) AS value, round(v / sum(v) OVER () * 100, 2) AS share_pct,
     count(*) OVER () AS groups FROM g ORDER BY v DESC LIMIT 1)
   SELECT "group", value, share_pct, groups, share_pct >= 100.0 / groups * 1.6 AS supported FROM s""")
def size_tests(spark, sf):
    totals = summaries.groupby_aggregate(load(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return drivers.size_tests(totals).select("group", F.round("value", 2).alias("value"), "share_pct",
                                             "groups", "supported")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1),
   e AS (SELECT count(*) AS points, arg_min(v, p) AS f, arg_max(v, p) AS l FROM m)
   SELECT points, round(l - f, 2) AS change, round((l - f) / f * 100, 4) AS change_pct,
     abs((l - f) / f * 100) > 10 AS supported FROM e""")
def trend_test(spark, sf):
    series = summaries.time_series(load(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return drivers.trend_test(series).select("points", F.round("change", 2).alias("change"),
                                             F.round("change_pct", 4).alias("change_pct"), "supported")


# --- statistical tests -------------------------------------------------------

@query("""WITH m AS (SELECT count(*) FILTER (l_linestatus = 'F') AS n_a, count(*) FILTER (l_linestatus = 'O') AS n_b,
     avg(l_extendedprice) FILTER (l_linestatus = 'F') AS ma, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS mb,
     var_samp(l_extendedprice) FILTER (l_linestatus = 'F') AS va, var_samp(l_extendedprice) FILTER (l_linestatus = 'O') AS vb
     FROM lineitem)
  SELECT n_a, n_b, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b,
     round((ma - mb) / sqrt(va / n_a + vb / n_b), 6) AS statistic,
     round((va / n_a + vb / n_b) ^ 2 / ((va / n_a) ^ 2 / (n_a - 1) + (vb / n_b) ^ 2 / (n_b - 1)), 4) AS dof,
     round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 4) AS cohens_d FROM m""")
def welch_ttest(spark, sf):
    return stattests.welch_moments(load(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus").select(
        "n_a", "n_b", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"),
        F.round("statistic", 6).alias("statistic"), F.round("dof", 4).alias("dof"), "cohens_d")


CHI = """WITH t AS (SELECT {a} AS a, {b} AS b, count(*) AS c FROM {table} GROUP BY ALL),
  ra AS (SELECT a, sum(c) AS na FROM t GROUP BY a), rb AS (SELECT b, sum(c) AS nb FROM t GROUP BY b),
  n AS (SELECT sum(c) AS n FROM t),
  g AS (SELECT coalesce(c, 0) AS c, na * nb / n AS e, (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM rb) AS k
     FROM ra, rb, n LEFT JOIN t ON t.a = ra.a AND t.b = rb.b)
  SELECT round(sum((abs(c - e) - CASE WHEN r = 2 AND k = 2 THEN least(0.5, abs(c - e)) ELSE 0 END) ^ 2 / e), 6)
    AS statistic, any_value((r - 1) * (k - 1)) AS dof, sum(c)::BIGINT AS n FROM g"""


@query(CHI.format(a="l_returnflag", b="l_linenumber", table="lineitem"))
def chi_square(spark, sf):
    return _chi(load(spark, sf, "lineitem"), "l_returnflag", "l_linenumber")


@query(CHI.format(a="quality", b="toxic", table="labels"))
def chi_square_two_by_two(spark, sf):
    return _chi(load(spark, sf, "labels"), "quality", "toxic")


def _chi(df, a, b):
    return stattests.chi_square_statistic(df, a, b).select(
        F.round("statistic", 6).alias("statistic"),
        ((F.col("ra") - 1) * (F.col("rb") - 1)).alias("dof"), "n")


@query("""SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n FROM lineitem""")
def pearson(spark, sf):
    found = stattests.pearson(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return spark.createDataFrame([(round(found["r"], 8), found["n"])], "r double, n long")


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope,
   round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
   round(regr_r2(l_extendedprice, l_quantity), 8) AS r_squared, count(*) AS n FROM lineitem""")
def linear_regression(spark, sf):
    m = stattests.linear_regression(load(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    c = m["coefficients"]
    return spark.createDataFrame(
        [(round(c["l_quantity"]["coef"], 5), round(c["const"]["coef"], 4), round(m["r_squared"], 8), m["n"])],
        "slope double, intercept double, r_squared double, n long")


# --- joins -------------------------------------------------------------------

MATCH = """WITH l AS (SELECT {lk} AS k, count(*) AS c FROM {left} GROUP BY 1),
   r AS (SELECT {rk} AS k, count(*) AS c FROM {right} GROUP BY 1),
   f AS (SELECT l.c AS lc, r.c AS rc FROM l FULL JOIN r USING (k))
   SELECT sum(lc)::BIGINT AS left_rows, sum(rc)::BIGINT AS right_rows,
     count(*) FILTER (lc > 0 AND rc > 0) AS matched_keys, count(*) FILTER (rc IS NULL) AS unmatched_left_keys,
     count(*) FILTER (lc IS NULL) AS unmatched_right_keys, max(lc) = 1 AS left_key_unique, max(rc) = 1 AS right_key_unique,
     round(count(*) FILTER (lc > 0 AND rc > 0) / count(lc), 4) AS match_rate,
     CASE WHEN max(lc) = 1 AND max(rc) = 1 THEN 'one-to-one' WHEN max(rc) = 1 THEN 'many-to-one'
       WHEN max(lc) = 1 THEN 'one-to-many' ELSE 'many-to-many' END AS cardinality FROM f"""


def _validated(left, right, on):
    return joining.validate_join(left, right, on).select(
        "left_rows", "right_rows", "matched_keys", "unmatched_left_keys", "unmatched_right_keys",
        "left_key_unique", "right_key_unique", "match_rate", "cardinality")


@query(MATCH.format(left="orders", lk="o_custkey", right="customer", rk="c_custkey"))
def join_validation(spark, sf):
    return _validated(load(spark, sf, "orders").withColumnRenamed("o_custkey", "key"),
                      load(spark, sf, "customer").withColumnRenamed("c_custkey", "key"), "key")


@query(MATCH.format(left="lineitem", lk="l_partkey", right="orders", rk="o_custkey"))
def join_validation_many_to_many(spark, sf):
    return _validated(load(spark, sf, "lineitem").withColumnRenamed("l_partkey", "key"),
                      load(spark, sf, "orders").withColumnRenamed("o_custkey", "key"), "key")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT doc_id, count(*) AS c FROM labels GROUP BY 1)
   SELECT 'doc_id' AS "column", round((SELECT count(*) FROM a JOIN b USING (doc_id)) / (SELECT count(*) FROM a)
     * (0.5 + 0.5 * (SELECT count(*) / sum(c) FROM b)), 6) AS score""")
def join_key_scores(spark, sf):
    out = joining.key_scores(load(spark, sf, "documents"), load(spark, sf, "labels"), ["doc_id"])
    return out.select("column", F.round("score", 6).alias("score"))


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
   LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def enrichment_join(spark, sf):
    extra = load(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey").select(
        "o_custkey", "c_mktsegment")
    merged = joining.enrich(load(spark, sf, "orders"), extra, "o_custkey")
    return merged.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"),
                                              F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- drift -------------------------------------------------------------------

CUT = "1998-06-01"


def _halves(spark, sf):
    o = load(spark, sf, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate",
                                         "o_custkey")
    early = F.col("o_orderdate") < F.lit(CUT).cast("timestamp")
    return o.where(early).drop("o_orderdate"), o.where(~early).drop("o_orderdate")


PSI = """WITH q AS (SELECT list_sort(list_distinct(quantile_cont({c}, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1]))) AS e
     FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01'),
   b AS (SELECT o_orderdate < TIMESTAMP '1998-06-01' AS early, len(list_filter(e[2:len(e) - 1], lambda x: x <= {c})) AS k
     FROM orders, q),
   g AS (SELECT unnest(range(0, (SELECT len(e) - 1 FROM q))) AS k),
   s AS (SELECT g.k, greatest(count(*) FILTER (early) / (SELECT count(*) FROM b WHERE early), 1e-6) AS p,
      greatest(count(*) FILTER (NOT early) / (SELECT count(*) FROM b WHERE NOT early), 1e-6) AS c
      FROM g LEFT JOIN b USING (k) GROUP BY g.k)
   SELECT '{c}' AS "column", round(sum((c - p) * ln(c / p)), 6) AS psi FROM s"""


@query(" UNION ALL ".join(f"SELECT * FROM ({PSI.format(c=c)})" for c in ("o_totalprice", "o_custkey")))
def population_stability(spark, sf):
    before, after = _halves(spark, sf)
    return drift.psi(before, after, ["o_totalprice", "o_custkey"]).select(
        "column", F.round("psi", 6).alias("psi"))


SHIFT = """SELECT * FROM (WITH s AS (SELECT {c} AS label, count(*) FILTER (early) / sum(count(*) FILTER (early)) OVER () AS p,
     count(*) FILTER (NOT early) / sum(count(*) FILTER (NOT early)) OVER () AS q
     FROM (SELECT *, o_orderdate < TIMESTAMP '1998-06-01' AS early FROM orders) GROUP BY 1)
   SELECT '{c}' AS "column", label AS changed_label, round(abs(q - p), 4) AS max_share_change FROM s
   ORDER BY abs(q - p) DESC, label LIMIT 1)"""


@query(" UNION ALL ".join(SHIFT.format(c=c) for c in ("o_orderstatus", "o_orderpriority")))
def category_shift(spark, sf):
    before, after = _halves(spark, sf)
    return drift.category_shift(before, after, ["o_orderstatus", "o_orderpriority"]).select(
        "column", "changed_label", "max_share_change")


DRIFT_MEANS = """SELECT '{c}' AS "column", {before} AS mean_before, {after} AS mean_after, 'low' AS severity FROM orders"""


@query(" UNION ALL ".join([DRIFT_MEANS.format(
    c=c, before=f"round(avg({c}) FILTER (o_orderdate < TIMESTAMP '1998-06-01'), 4)",
    after=f"round(avg({c}) FILTER (o_orderdate >= TIMESTAMP '1998-06-01'), 4)")
    for c in ("o_totalprice", "o_custkey")] + [
    DRIFT_MEANS.format(c=c, before="any_value(NULL::DOUBLE)", after="any_value(NULL::DOUBLE)")
    for c in ("o_orderstatus", "o_orderpriority")]))
def drift_report(spark, sf):
    before, after = _halves(spark, sf)
    return drift.detect_drift(before, after).select("column", "mean_before", "mean_after", "severity")
