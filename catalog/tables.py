"""Sources, filters, summaries and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import load, query, scratch
from inquest.functions.exactsums import exact_sum
from inquest.operators import filters, summaries
from inquest.sources import readers
from inquest.sources.versions import VersionStore, list_datasets, lineage

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(CUSTOMER)
def scan_csv(spark, sf):
    path = scratch(spark)
    load(spark, sf, "customer").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, "
                                         "c_acctbal double, c_mktsegment string")


@query(CUSTOMER)
def scan_tsv(spark, sf):
    path = scratch(spark)
    load(spark, sf, "customer").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_csv(spark, path, sep="\t")


@query(CUSTOMER)
def scan_json(spark, sf):
    path = scratch(spark)
    load(spark, sf, "customer").write.json(path)
    return readers.read_json(spark, path, lines=True).select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def scan_parquet(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                            F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""SELECT 2 AS versions, count(*) AS rows_raw, count(*) FILTER (o_orderstatus = 'F') AS rows_scoped,
          1 AS parents FROM orders""")
def version_lineage(spark, sf):
    """Two versions of the orders, the second a slice of the first."""
    store = VersionStore(spark, scratch(spark))
    orders = load(spark, sf, "orders")
    first = store.write(orders, "orders")
    second = store.write(orders.where("o_orderstatus = 'F'"), "orders", "scoped", first["version_id"],
                         set_current=False)
    walk = lineage(store.manifest(), second["version_id"]).agg(F.max("steps").cast("int").alias("parents"))
    current = store.load(store.resolve("orders")).agg(F.count(F.lit(1)).alias("rows_raw"))
    part = store.load(second).agg(F.count(F.lit(1)).alias("rows_scoped"))
    return (list_datasets(store.manifest()).select(F.col("versions").cast("int").alias("versions"))
            .withColumn("rows_raw", current.scalar()).withColumn("rows_scoped", part.scalar())
            .withColumn("parents", walk.scalar()))


@query("""SELECT url AS name, sha256(html) AS checksum, octet_length(encode(html)) AS size_bytes,
          CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '://[^/]+/.*\\.(html|htm|pdf|txt|md|csv)$')
               THEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[A-Za-z0-9]+)$', 1))
               ELSE '.html' END AS source_format FROM pages""")
def register_page_sources(spark, sf):
    return readers.register_pages(load(spark, sf, "pages")).select(
        "name", "checksum", "size_bytes", "source_format")


@query("SELECT source, (sum(length(text)) + count(*))::BIGINT AS characters FROM documents GROUP BY source")
def scan_documents(spark, sf):
    """Whole files as text: the documents of each source, at most 1000 in a file."""
    path = scratch(spark)
    (load(spark, sf, "documents").select("source", F.col("text").alias("value"))
     .repartition("source").write.partitionBy("source").option("maxRecordsPerFile", 1000).text(path))
    files = readers.read_documents(spark, f"{path}/*/*.txt")
    return files.groupBy(F.regexp_extract("path", r"source=([^/]+)", 1).alias("source")).agg(
        F.sum(F.length("text")).alias("characters"))


@query("""SELECT o_orderkey, o_totalprice FROM orders
          WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1998-06-30'""")
def period_scope(spark, sf):
    return filters.period_scope(load(spark, sf, "orders"), "1997-01-01", "1998-06-30").select(
        "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def segment_filter(spark, sf):
    return filters.where_equal(load(spark, sf, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F"}
                               ).select("l_orderkey", "l_linenumber")


@query("""SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer
          GROUP BY c_mktsegment""")
def readonly_sql(spark, sf):
    return filters.readonly_sql(load(spark, sf, "customer"), """
        SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM data
        GROUP BY c_mktsegment;""")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'""")
def visible_rows(spark, sf):
    rows = load(spark, sf, "customer").withColumn("is_deleted", F.col("c_acctbal") < 0).withColumn(
        "owner_id", F.col("c_mktsegment"))
    return filters.visible(rows, "BUILDING").select("c_custkey", "c_name")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
   round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25,
   round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75,
   max({c})::DOUBLE AS max FROM lineitem"""
   for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")))
def describe(spark, sf):
    out = summaries.describe(load(spark, sf, "lineitem"), [
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
    return out.select("column", "count", "min", "max",
                      *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@query("""SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL
          GROUP BY event_type ORDER BY count DESC, value LIMIT 20""")
def value_counts(spark, sf):
    return summaries.value_counts(load(spark, sf, "events"), "event_type")


@query("""WITH g AS (SELECT l_returnflag || ' | ' || l_linestatus AS "group", sum(l_extendedprice) AS v
            FROM lineitem GROUP BY ALL)
          SELECT "group", round(v, 2) AS value, round(v / sum(v) OVER () * 100, 2) AS share_pct FROM g""")
def group_totals(spark, sf):
    out = summaries.groupby_aggregate(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                                      "l_extendedprice")
    return out.select("group", F.round("value", 2).alias("value"), "share_pct")


@query("""WITH d AS (SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS s, c_acctbal FROM customer)
          SELECT coalesce(s, 'nan') AS "group", round(sum(c_acctbal), 2) AS value,
          round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM d) * 100, 2) AS share_pct FROM d GROUP BY s""")
def group_totals_missing_key(spark, sf):
    rows = load(spark, sf, "customer").withColumn(
        "s", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    out = summaries.groupby_aggregate(rows, "s", "c_acctbal")
    return out.select("group", F.round("value", 2).alias("value"), "share_pct")


def _group_query(name, agg, sql):
    def run(spark, sf):
        out = summaries.groupby_aggregate(load(spark, sf, "orders"), "o_orderpriority",
                                          "o_totalprice", agg)
        return out.select("group", F.round("value", 5).alias("value"))
    run.__name__ = name
    query(f"""SELECT o_orderpriority AS "group", round({sql}, 5) AS value FROM orders
              GROUP BY o_orderpriority""")(run)


for _agg, _sql in (("mean", "avg(o_totalprice)"), ("median", "quantile_cont(o_totalprice, 0.5)"),
                   ("count", "count(o_totalprice)::DOUBLE"), ("min", "min(o_totalprice)"),
                   ("max", "max(o_totalprice)"), ("std", "stddev_samp(o_totalprice)"),
                   ("nunique", "count(DISTINCT o_totalprice)::DOUBLE")):
    _group_query(f"group_{_agg}", _agg, _sql)


@query("""WITH r AS (""" + " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS correlation FROM lineitem"""
    for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i + 1:]) + ") SELECT * FROM r")
def correlation_matrix(spark, sf):
    return summaries.correlation(load(spark, sf, "lineitem"),
                                 ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


SPINE = """WITH m AS (SELECT date_trunc('{unit}', {date})::DATE AS p, {agg} AS v FROM {table} GROUP BY 1),
 s AS (SELECT unnest(generate_series((SELECT min(p) FROM m), (SELECT max(p) FROM m), INTERVAL {step}))::DATE AS p)
 SELECT {label} AS period, {value} AS value FROM s LEFT JOIN m USING (p)"""


@query(SPINE.format(unit="month", date="o_orderdate", agg="sum(o_totalprice)", table="orders", step="1 MONTH",
                    label="strftime(last_day(s.p), '%Y-%m-%d')", value="round(coalesce(v, 0), 2)"))
def time_series_month(spark, sf):
    out = summaries.time_series(load(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return out.select(F.col("period").cast("string").alias("period"), F.round("value", 2).alias("value"))


@query(SPINE.format(unit="day", date="ts", agg="avg(value)", table="events", step="1 DAY",
                    label="strftime(s.p, '%Y-%m-%d')", value="round(v, 6)"))
def time_series_day_mean(spark, sf):
    out = summaries.time_series(load(spark, sf, "events"), "ts", "value", "D", "mean")
    return out.select(F.col("period").cast("string").alias("period"), F.round("value", 6).alias("value"))


@query(SPINE.format(unit="week", date="l_shipdate", agg="count(l_quantity)", table="lineitem", step="7 DAY",
                    label="strftime(s.p + INTERVAL 6 DAY, '%Y-%m-%d')", value="coalesce(v, 0)::DOUBLE"))
def time_series_week_count(spark, sf):
    out = summaries.time_series(load(spark, sf, "lineitem"), "l_shipdate", "l_quantity", "W", "count")
    return out.select(F.col("period").cast("string").alias("period"), "value")


@query(SPINE.format(unit="quarter", date="o_orderdate", agg="max(o_totalprice)", table="orders", step="3 MONTH",
                    label="strftime(last_day(s.p + INTERVAL 2 MONTH), '%Y-%m-%d')", value="round(v, 2)"))
def time_series_quarter_max(spark, sf):
    out = summaries.time_series(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", "Q", "max")
    return out.select(F.col("period").cast("string").alias("period"), F.round("value", 2).alias("value"))


@query("""WITH m AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::DATE AS p,
            median(o_totalprice) AS v FROM orders GROUP BY ALL)
          SELECT k AS o_orderpriority, strftime(last_day(p), '%Y-%m-%d') AS period, round(v, 4) AS value
          FROM m WHERE v IS NOT NULL""")
def series_per_group(spark, sf):
    out = summaries.build_series(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", agg="median",
                                 keys=["o_orderpriority"])
    return out.select("o_orderpriority", F.col("period").cast("string").alias("period"),
                      F.round("value", 4).alias("value"))


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice::DECIMAL(38, 2) AS v, l_orderkey % 3 AS k FROM lineitem)
   SELECT l_returnflag, sum(v * CASE k WHEN 0 THEN 1000000000 ELSE 1 END)::DOUBLE AS large,
     sum(v)::DOUBLE AS plain, (sum(CASE k WHEN 0 THEN 4503599627370496 WHEN 1 THEN -4503599627370496 ELSE 0 END::HUGEINT)
       + sum(0.25::DECIMAL(38, 2)))::DOUBLE AS cancelled FROM r GROUP BY 1""")
def exact_totals(spark, sf):
    """Sums that do not depend on the order of the rows, also where large values cancel out."""
    k = F.pmod("l_orderkey", F.lit(3))
    rows = load(spark, sf, "lineitem").withColumns({
        "large": F.round(F.col("l_extendedprice") * F.when(k == 0, 1e9).otherwise(1.0), 2),
        "big": F.when(k == 0, 4503599627370496.25).when(k == 1, -4503599627370495.75).otherwise(0.25)})
    return rows.groupBy("l_returnflag").agg(
        exact_sum(F.col("large")).alias("large"), exact_sum(F.col("l_extendedprice")).alias("plain"),
        exact_sum(F.col("big")).alias("cancelled"))


@query("""SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS count FROM lineitem GROUP BY ALL""")
def contingency(spark, sf):
    return summaries.contingency(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag'
                      WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus'
                      WHEN grouping(l_shipdate) = 0 THEN 'l_shipdate' END AS dimension,
          coalesce(l_returnflag, l_linestatus, l_shipdate::VARCHAR) AS "group",
          round(sum(l_extendedprice), 2) AS value
          FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_shipdate))""")
def metric_snapshot(spark, sf):
    out = summaries.metric_snapshot(load(spark, sf, "lineitem"), "l_extendedprice",
                                    ["l_returnflag", "l_linestatus", "l_shipdate"])
    return out.select("dimension", "group", F.round("value", 2).alias("value"))


@query("""SELECT p_brand AS "group", round(sum(p_retailprice), 2) AS value FROM part GROUP BY p_brand
          ORDER BY value DESC, "group" LIMIT 20""")
def bar_chart_frame(spark, sf):
    return summaries.bar_frame(load(spark, sf, "part"), "p_brand", "p_retailprice").select(
        "group", F.round("value", 2).alias("value"))


@query("""WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
          SELECT least(floor((c_acctbal - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS count
          FROM customer, e GROUP BY 1""")
def histogram_frame(spark, sf):
    return summaries.histogram(load(spark, sf, "customer"), "c_acctbal").select("bin", "count")


@query("SELECT p_size AS x, p_retailprice AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL")
def scatter_frame(spark, sf):
    return summaries.scatter_frame(load(spark, sf, "part"), "p_size", "p_retailprice")
