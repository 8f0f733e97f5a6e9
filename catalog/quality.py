"""Profiling, cleaning, redaction and evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.common import DIRTY_SQL, dirty_orders, load, query
from inquest.functions.quantiles import column_quantiles, grouped_quantiles
from inquest.operators import (anomalies, cleaning, duplicates, evaluation, profiling, redaction)

NOW = dt.datetime(2025, 1, 1)
DIRTY = ("order_id", "total_price", "status", "order_date", "constant", "priority")


@query(f"WITH {DIRTY_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS inferred_type, count(*) - count({c}) AS null_count,
        count(DISTINCT {c}) AS unique_count FROM dirty"""
    for c, kind in zip(DIRTY, ("numeric", "numeric", "categorical", "datetime", "categorical", "categorical"))))
def column_profile(spark, sf):
    p = profiling.profile(dirty_orders(spark, sf), NOW, anomalies=False)
    return p.columns_df(spark).select("column", "inferred_type", "null_count", "unique_count")


@query(f"""WITH {DIRTY_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (total_price < 0) AS neg,
     count(*) FILTER (total_price IS NULL) AS np, count(*) FILTER (status IS NULL) AS ns, count(status) AS hs,
     count(*) FILTER (order_date = 'not-a-date') AS bad, count(order_id) - count(DISTINCT order_id) AS rep FROM dirty)
   SELECT 'total_price' AS "column", 'missing_values' AS issue, np AS affected_rows FROM s
   UNION ALL SELECT 'total_price', 'invalid_range', neg FROM s
   UNION ALL SELECT 'status', 'missing_values', ns FROM s
   UNION ALL SELECT 'status', 'inconsistent_categories', hs FROM s
   UNION ALL SELECT 'order_date', 'date_problems', bad FROM s
   UNION ALL SELECT 'constant', 'constant_column', n FROM s
   UNION ALL SELECT 'order_id', 'duplicate_keys', rep FROM s""")
def column_issues(spark, sf):
    p = profiling.profile(dirty_orders(spark, sf), NOW, anomalies=False)
    wanted = ["missing_values", "invalid_range", "inconsistent_categories", "date_problems",
              "constant_column", "duplicate_keys"]
    return p.issues_df(spark).where(F.col("issue").isin(wanted)).select(
        "column", "issue", "affected_rows")


@query(f"""WITH {DIRTY_SQL}, v AS (
     SELECT 'status' AS "column", status AS value, count(*) AS n FROM dirty WHERE status IS NOT NULL GROUP BY 2
     UNION ALL SELECT 'priority', priority, count(*) FROM dirty GROUP BY 2
     UNION ALL SELECT 'order_date', order_date, count(*) FROM dirty GROUP BY 2),
   r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k FROM v)
   SELECT "column", value, n FROM r WHERE k <= 10""")
def top_values(spark, sf):
    from pyspark.sql import Window
    values = profiling.value_table(dirty_orders(spark, sf).select("status", "priority", "order_date"))
    rank = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return values.withColumn("k", F.row_number().over(rank)).where("k <= 10").drop("k")


@query("""SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_linenumber, l_quantity, l_discount, l_tax FROM lineitem))
          AS duplicate_rows FROM lineitem""")
def duplicate_rows(spark, sf):
    return profiling.duplicate_rows(load(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", "l_tax"))


OUT = """SELECT * FROM (WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS md, quantile_cont({c}, 0.75) AS q3 FROM {t}),
   m AS (SELECT quantile_cont(abs({c} - md), 0.5) AS mad, avg(abs({c} - md)) AS mean FROM {t}, q),
   s AS (SELECT CASE WHEN mad > 0 THEN mad ELSE mean END AS sc, CASE WHEN mad > 0 THEN 0.6745 ELSE 0.7979 END AS k FROM m)
   SELECT '{c}' AS "column", count({c}) AS count, round(any_value(md), 5) AS median, round(any_value(sc), 4) AS scale,
     count(*) FILTER (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS outliers,
     count(*) FILTER (sc > 0 AND k * abs({c} - md) / sc > 3.5) AS extreme_outliers FROM {t}, q, s)"""


@query(" UNION ALL ".join(OUT.format(c=c, t="documents") for c in ("n_chars",)) + " UNION ALL "
       + " UNION ALL ".join(OUT.format(c=c, t="lineitem") for c in ("l_extendedprice", "l_quantity")))
def outlier_counts(spark, sf):
    a = anomalies.outlier_counts(load(spark, sf, "documents"), ["n_chars"])
    b = anomalies.outlier_counts(load(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    return a.unionByName(b).select("column", "count", F.round("median", 5).alias("median"),
                                   F.round("scale", 4).alias("scale"), "outliers", "extreme_outliers")


@query()
def anomaly_scores(spark, sf):
    return anomalies.anomaly_scores(load(spark, sf, "lineitem"),
                                    ["l_quantity", "l_extendedprice", "l_discount"],
                                    ["l_orderkey", "l_linenumber"])


@query("""WITH RECURSIVE l AS (SELECT DISTINCT col AS "column", label FROM (
       SELECT 'type' AS col, lower(p_type) AS label FROM part UNION ALL SELECT 'brand', lower(p_brand) FROM part
       UNION ALL SELECT 'opening', lower(regexp_extract(text, '^[A-Za-z]+')) FROM documents) WHERE length(label) >= 4),
     p AS (SELECT row_number() OVER () AS id, a."column", a.label AS a, b.label AS b FROM l a JOIN l b
       ON a."column" = b."column" AND a.label < b.label AND abs(length(a.label) - length(b.label)) <= 3),
     c AS (SELECT id, i, j, substr(a, i, 1) = substr(b, j, 1) AS eq FROM (
       SELECT id, a, b, unnest(range(1, length(a) + 1)) AS i FROM p),
       LATERAL (SELECT unnest(range(1, length(b) + 1)) AS j)),
     r AS (SELECT id, i, j, row_number() OVER (PARTITION BY id, j - i, g ORDER BY i) AS run FROM (
       SELECT *, sum(CASE WHEN eq THEN 0 ELSE 1 END) OVER (PARTITION BY id, j - i ORDER BY i) AS g FROM c) WHERE eq),
     m AS (
       SELECT id, 1 AS t, CAST(length(a) AS BIGINT) + 1 AS u, 1::BIGINT AS v,
              CAST(length(b) AS BIGINT) + 1 AS w, 0::BIGINT AS k FROM p
       UNION ALL
       SELECT id, x.t, x.u, x.v, x.w, x.k FROM (
         SELECT id, unnest([{'t': t, 'u': e.i - e.k + 1, 'v': v, 'w': e.j - e.k + 1, 'k': e.k},
                            {'t': e.i + 1, 'u': u, 'v': e.j + 1, 'w': w, 'k': 0}]) AS x FROM (
           SELECT m.id, t, u, v, w, arg_max({'i': i, 'j': j, 'k': least(run, i - t + 1, j - v + 1)},
                    least(run, i - t + 1, j - v + 1) * 1000000 - (i * 1000 + j)) AS e
           FROM m JOIN r ON r.id = m.id AND i >= t AND i < u AND j >= v AND j < w
           GROUP BY m.id, t, u, v, w)))
   SELECT "column", a AS label, b AS other, 2.0 * n / (length(a) + length(b)) AS ratio
   FROM p JOIN (SELECT id, sum(k) AS n FROM m GROUP BY id) USING (id)
   WHERE 2.0 * n / (length(a) + length(b)) >= 0.8""")
def similar_labels(spark, sf):
    part, docs = load(spark, sf, "part"), load(spark, sf, "documents")
    rows = part.select(F.col("p_type").alias("type"), F.col("p_brand").alias("brand")).unionByName(
        docs.select(F.regexp_extract("text", "^[A-Za-z]+", 0).alias("opening")), allowMissingColumns=True)
    return profiling.similar_labels(rows, ["type", "brand", "opening"])


@query("""SELECT 'ts' AS "column", count(*) AS steps FROM (
     SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events) WHERE ts < before
   HAVING count(*) >= 0""")
def backward_steps(spark, sf):
    return profiling.backward_steps(profiling.ordered_by(load(spark, sf, "events"), "event_id"), ["ts"])


@query("""SELECT 'o_orderdate' AS "column", count(*) AS steps FROM (
     SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS before FROM orders)
   WHERE o_orderdate < before""")
def backward_steps_orders(spark, sf):
    return profiling.backward_steps(profiling.ordered_by(load(spark, sf, "orders"), "o_orderkey"),
                                    ["o_orderdate"])


@query("""SELECT unnest(['l_extendedprice', 'l_quantity']) AS "column",
   unnest([round(quantile_cont(l_extendedprice, 0.9), 4), round(quantile_cont(l_quantity, 0.9), 4)]) AS p90
   FROM lineitem""")
def exact_quantiles_narrowed(spark, sf):
    """The path for tables too large to buffer, forced by a buffer of no rows."""
    out = column_quantiles(load(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], [0.9],
                           buffered_rows=0)
    return out.select("column", F.round(F.col("q")[0], 4).alias("p90"))


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
   round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1""")
def grouped_quantiles_narrowed(spark, sf):
    out = grouped_quantiles(load(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", [0.25, 0.75],
                            buffered_rows=0)
    return out.select("o_orderpriority", F.round(F.col("q")[0], 4).alias("q1"),
                      F.round(F.col("q")[1], 4).alias("q3"))


# --- cleaning ----------------------------------------------------------------

@query(f"""WITH {DIRTY_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (total_price < 0) AS neg,
     count(*) FILTER (total_price IS NULL) AS np, count(*) FILTER (status IS NULL) AS ns, count(status) AS hs,
     count(*) FILTER (status <> trim(status)) AS pad, count(order_date) AS nd FROM dirty)
   SELECT 'strip_whitespace::status' AS op_id, pad AS estimated_affected_rows FROM s
   UNION ALL SELECT 'normalize_category_casing::status', hs FROM s
   UNION ALL SELECT 'coerce_datetime::order_date', nd FROM s
   UNION ALL SELECT 'null_out_negative_values::total_price', neg FROM s
   UNION ALL SELECT 'impute_missing_median::total_price', np FROM s
   UNION ALL SELECT 'impute_missing_mode::status', ns FROM s
   UNION ALL SELECT 'drop_constant_columns::constant', n FROM s
   UNION ALL SELECT 'drop_exact_duplicates', n - d FROM s,
     (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM dirty)) WHERE n > d""")
def cleaning_plan(spark, sf):
    return cleaning.propose_plan(dirty_orders(spark, sf)).to_df(spark).select(
        "op_id", "estimated_affected_rows")


@query(f"""WITH {DIRTY_SQL}, d AS (SELECT DISTINCT order_id, total_price, upper(trim(status)) AS status, order_date, constant, priority FROM dirty),
   p AS (SELECT * REPLACE (CASE WHEN total_price >= 0 THEN total_price END AS total_price) FROM d),
   m AS (SELECT quantile_cont(total_price, 0.5) AS md FROM p),
   mo AS (SELECT status AS ms FROM p WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
   SELECT coalesce(status, ms) AS status, count(*) AS n, round(sum(coalesce(total_price, md)), 2) AS total,
     count(try_cast(order_date AS DATE)) AS dated FROM p, m, mo GROUP BY 1""")
def cleaning_applied(spark, sf):
    rows = dirty_orders(spark, sf)
    plan = cleaning.propose_plan(rows)
    clean, _ = cleaning.apply_plan(rows, plan, [o.op_id for o in plan.operations])
    return clean.groupBy("status").agg(F.count(F.lit(1)).alias("n"),
                                       F.round(F.sum("total_price"), 2).alias("total"),
                                       F.count("order_date").alias("dated"))


@query(f"""WITH {DIRTY_SQL}, d AS (SELECT DISTINCT order_id, total_price, upper(trim(status)) AS status, order_date, constant, priority FROM dirty),
   b AS (SELECT count(*) AS n, count(status) AS hs FROM dirty),
   a AS (SELECT count(*) AS n, count(try_cast(order_date AS DATE)) AS dated, count(*) FILTER (total_price < 0) AS neg,
     count(*) FILTER (total_price IS NULL OR total_price < 0) AS np, count(*) FILTER (status IS NULL) AS ns FROM d)
   SELECT unnest(['strip_whitespace::status', 'normalize_category_casing::status', 'drop_exact_duplicates',
     'coerce_datetime::order_date', 'null_out_negative_values::total_price', 'impute_missing_median::total_price',
     'impute_missing_mode::status', 'drop_constant_columns::constant']) AS op_id,
     unnest([b.hs, b.hs, b.n - a.n, a.dated, a.neg, a.np, a.ns, a.n]) AS actual_affected_rows,
     'order_id,total_price,status,order_date,priority' AS columns FROM a, b""")
def cleaning_log(spark, sf):
    """What each operation touched, before and after copies go, and the columns that are left."""
    rows = dirty_orders(spark, sf)
    plan = cleaning.propose_plan(rows)
    clean, log = cleaning.apply_plan(rows, plan, [o.op_id for o in plan.operations])
    return log.to_df(spark).select("op_id", "actual_affected_rows", F.lit(",".join(clean.columns)).alias("columns"))


@query(f"""WITH {DIRTY_SQL} SELECT order_id, total_price, status, order_date, priority, count(*) AS copies
   FROM dirty GROUP BY ALL HAVING count(*) > 1""")
def repeated_rows(spark, sf):
    return duplicates.repeated_rows(dirty_orders(spark, sf).drop("constant"))


# --- redaction ---------------------------------------------------------------

@query("""SELECT c_custkey, 'İß🤖 call [REDACTED]7, ' || CASE WHEN k.c_name IS NULL
     THEN 'cuſtomer#' || lpad((c_custkey * 3)::VARCHAR, 9, '0') ELSE '[REDACTED]' END || ' in [REDACTED].' AS note
   FROM customer LEFT JOIN (SELECT DISTINCT c_name FROM customer) k
     ON k.c_name = 'Customer#' || lpad((customer.c_custkey * 3)::VARCHAR, 9, '0')""")
def redacted_text(spark, sf):
    """Known and unknown names in odd cases, behind letters that grow when lower-cased."""
    c = load(spark, sf, "customer")
    other = F.concat(F.lit("cuſtomer#"), F.lpad((F.col("c_custkey") * 3).cast("string"), 9, "0"))
    notes = c.select("c_custkey", F.concat(F.lit("İß🤖 call "), F.upper("c_name"), F.lit("7, "), other,
                                           F.lit(" in "), F.lower("c_mktsegment"), F.lit(".")).alias("note"))
    return redaction.scrub_column(notes, "note", redaction.sensitive_values(c, ["c_name", "c_mktsegment"]))


@query("""SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer GROUP BY 2
   UNION ALL SELECT 'c_name', c_name FROM (SELECT DISTINCT c_name FROM customer)""")
def sensitive_values(spark, sf):
    return redaction.sensitive_values(load(spark, sf, "customer"), ["c_mktsegment", "c_name"])


@query("SELECT c_custkey, '[REDACTED]' AS c_name, c_mktsegment FROM customer")
def withheld_samples(spark, sf):
    return redaction.withhold_rows(load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"),
                                   ["c_name"])


# --- evaluation --------------------------------------------------------------

ISSUES_SQL = """truth AS (SELECT doc_id::VARCHAR AS "column", 'outliers' AS issue FROM labels WHERE quality = 0
     UNION ALL SELECT doc_id::VARCHAR, 'missing_values' FROM labels WHERE toxic = 1),
   found AS (SELECT doc_id::VARCHAR AS "column", 'extreme_outliers' AS issue FROM documents WHERE n_chars < 800
     UNION ALL SELECT doc_id::VARCHAR, 'missing_values' FROM documents WHERE lang = 'en')"""


def _issues(spark, sf):
    d, lab = load(spark, sf, "documents"), load(spark, sf, "labels")
    key = F.col("doc_id").cast("string").alias("column")
    truth = lab.where("quality = 0").select(key, F.lit("outliers").alias("issue")).unionByName(
        lab.where("toxic = 1").select(key, F.lit("missing_values").alias("issue")))
    found = d.where("n_chars < 800").select(key, F.lit("extreme_outliers").alias("issue")).unionByName(
        d.where("lang = 'en'").select(key, F.lit("missing_values").alias("issue")))
    return truth, found


@query(f"""WITH {ISSUES_SQL}, t AS (SELECT "column", CASE issue WHEN 'outliers' THEN 'extreme_outliers' ELSE issue END AS issue
     FROM (SELECT DISTINCT * FROM truth)),
   h AS (SELECT count(*) AS expected, count(*) FILTER (("column", issue) IN (SELECT ("column", issue) FROM found)) AS detected FROM t),
   s AS (SELECT count(*) AS wrong FROM (SELECT DISTINCT * FROM found) f WHERE ("column", issue) NOT IN (SELECT ("column", issue) FROM t)),
   r AS (SELECT expected, detected, detected / expected AS rec, detected / greatest(detected + wrong, 1) AS pre FROM h, s)
   SELECT expected, detected, round(rec, 3) AS recall, round(pre, 3) AS precision,
     CASE WHEN rec + pre > 0 THEN round(2 * rec * pre / (rec + pre), 3) ELSE 0 END AS f1 FROM r""")
def issue_detection_score(spark, sf):
    truth, found = _issues(spark, sf)
    return evaluation.quality_detection(truth, found).select(
        "expected", "detected", "recall", "precision", "f1")


@query("""SELECT l_suppkey::VARCHAR AS run, round(abs(sum(l_extendedprice * (1 - l_discount)) - sum(l_extendedprice))
     / sum(l_extendedprice), 4) AS relative_error,
     abs(sum(l_extendedprice * (1 - l_discount)) - sum(l_extendedprice)) / sum(l_extendedprice) <= 0.05 AS correct
   FROM lineitem GROUP BY 1""")
def numerical_accuracy(spark, sf):
    pairs = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("run")).agg(
        F.sum("l_extendedprice").alias("expected"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("reported"))
    return evaluation.numerical_accuracy(pairs).select("run", "relative_error", "correct")


FINDINGS_SQL = """f AS (SELECT o_custkey::VARCHAR AS investigation_id,
    CASE o_orderstatus WHEN 'F' THEN 'driver' WHEN 'O' THEN 'association' ELSE 'measurement' END AS finding_type,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'verified' WHEN o_orderpriority LIKE '5%' THEN 'failed_verification'
      ELSE 'pending' END AS verification_status,
    CASE WHEN o_totalprice > 100000 THEN o_orderkey::VARCHAR END AS tool_run_id, o_totalprice, o_orderkey FROM orders)"""


def _findings(spark, sf):
    o = load(spark, sf, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("investigation_id"),
        F.when(status == "F", "driver").when(status == "O", "association").otherwise("measurement")
        .alias("finding_type"),
        F.when(priority.startswith("1"), "verified").when(priority.startswith("5"), "failed_verification")
        .otherwise("pending").alias("verification_status"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_orderkey").cast("string")).alias("tool_run_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("statement"),
        F.lit("computed").alias("evidence_summary"), F.col("o_totalprice").alias("magnitude"),
        F.lit("price").alias("unit"),
        F.when(F.col("o_totalprice") > 150000, "high").otherwise("medium").alias("confidence"))


@query(f"""WITH {FINDINGS_SQL} SELECT investigation_id, count(*) AS findings,
     count(*) FILTER (finding_type <> 'measurement') AS causal_claims,
     count(*) FILTER (verification_status = 'verified') AS verified, round(count(tool_run_id) / count(*), 3) AS traceability_rate,
     coalesce(round(count(*) FILTER (finding_type <> 'measurement' AND tool_run_id IS NULL)
       / nullif(count(*) FILTER (finding_type <> 'measurement'), 0), 3), 0) AS unsupported_claim_rate
   FROM f GROUP BY 1""")
def finding_rates(spark, sf):
    return evaluation.finding_rates(_findings(spark, sf))


@query(f"""WITH {FINDINGS_SQL} SELECT investigation_id,
     count(*) FILTER (verification_status <> 'pending') AS checked,
     round(count(*) FILTER (verification_status = 'verified') / nullif(count(*) FILTER (verification_status <> 'pending'), 0), 3) AS accuracy
   FROM f GROUP BY 1""")
def verification_rates(spark, sf):
    return evaluation.verification_rates(_findings(spark, sf))


@query(f"""WITH {FINDINGS_SQL} SELECT investigation_id FROM f GROUP BY 1
   HAVING bool_or(finding_type = 'measurement') AND NOT bool_or(finding_type = 'driver')""")
def evidence_gaps(spark, sf):
    from inquest.operators.drivers import evidence_gaps as gaps
    return gaps(_findings(spark, sf))


@query(f"""WITH {FINDINGS_SQL} SELECT investigation_id, o_orderkey::VARCHAR AS id, row_number() OVER (PARTITION BY investigation_id
     ORDER BY CASE finding_type WHEN 'driver' THEN 0 WHEN 'association' THEN 1 ELSE 2 END,
       CASE WHEN o_totalprice > 150000 THEN 0 ELSE 1 END, o_totalprice DESC, 'order ' || o_orderkey) AS rank FROM f""")
def ranked_findings(spark, sf):
    from inquest.operators.drivers import rank_findings
    return rank_findings(_findings(spark, sf)).select("investigation_id", "id", "rank")


@query(f"""WITH {FINDINGS_SQL}, v AS (SELECT *, CASE WHEN o_totalprice > 150000 THEN 0.55 ELSE 0.35 END AS lo,
     CASE WHEN o_totalprice > 150000 THEN 0.80 ELSE 0.60 END AS hi, CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.65 END AS w
     FROM f WHERE finding_type = 'driver' AND verification_status = 'verified')
   SELECT investigation_id, o_orderkey::VARCHAR AS finding_id, row_number() OVER (PARTITION BY investigation_id
     ORDER BY (round(o_totalprice * lo, 2) + round(o_totalprice * hi, 2)) / 2 * w * 0.7 DESC, o_orderkey::VARCHAR) AS rank,
     round(o_totalprice, 2) AS addressable_gap, 'medium' AS urgency FROM v""")
def recommendations(spark, sf):
    from inquest.operators.drivers import recommendations as recommend
    from inquest.sources.records import SCHEMAS
    none = spark.createDataFrame([], SCHEMAS["forecasts"])
    out = recommend(_findings(spark, sf), none)
    return out.select("investigation_id", "finding_id", "rank", "addressable_gap", "urgency")


@query("""SELECT count(*) AS feedback, round(count(*) FILTER (event_type = 'purchase') / count(*), 3) AS adoption_rate,
     round(avg(CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END), 2) AS mean_rating FROM events""")
def feedback_rates(spark, sf):
    adopted = F.col("event_type") == "purchase"
    rows = load(spark, sf, "events").select(
        F.lit("recommendation").alias("target_type"), adopted.alias("was_adopted"),
        F.when(adopted, 5).otherwise(1).alias("rating"))
    return evaluation.feedback_rates(rows)


@query("""SELECT doc_id::VARCHAR AS run_id, contains(lower(text), 'the of') OR contains(lower(text), 'que la') AS used_document
   FROM documents""")
def document_evidence(spark, sf):
    rows = load(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("run_id"), "text",
        F.array(F.lit("The of"), F.lit("que la")).alias("terms"))
    return evaluation.evidence_terms(rows).select("run_id", "used_document")
