"""Loading and shared derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from inquest.sources.readers import read_parquet

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL when it has one."""
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return keep


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names for checkpoints."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile
        base = tempfile.mkdtemp(prefix="inquest-scratch-")
    return f"{base}/catalog-{uuid.uuid4().hex}"


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Every order, some of them twice, with the defects a cleaning run has to find."""
    o = load(spark, folder, "orders")
    o = o.unionByName(o.where("o_orderkey % 29 = 0"))
    k = F.col("o_orderkey")
    price = F.when(k % 17 == 0, None).when(k % 23 == 0, -F.col("o_totalprice")).otherwise(
        F.col("o_totalprice"))
    status = F.when(k % 7 == 0, F.concat(F.lit("  "), F.lower("o_orderstatus"), F.lit(" "))).when(
        k % 11 == 0, None).otherwise(F.col("o_orderstatus"))
    day = F.when(k % 41 == 0, "not-a-date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(F.floor(k / 2).alias("order_id"), price.alias("total_price"),
                    status.alias("status"), day.alias("order_date"),
                    F.lit("x").alias("constant"), F.col("o_orderpriority").alias("priority"))


DIRTY_SQL = """dirty AS (
  SELECT o_orderkey // 2 AS order_id,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN -o_totalprice
         ELSE o_totalprice END AS total_price,
    CASE WHEN o_orderkey % 7 = 0 THEN '  ' || lower(o_orderstatus) || ' '
         WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 41 = 0 THEN 'not-a-date'
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
    'x' AS constant, o_orderpriority AS priority
  FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 29 = 0))"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The document table in the shape of the index."""
    none = F.lit(None).cast("string")
    return load(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"), "text", F.col("source").alias("title"),
        F.when(F.col("lang") == "de", "kpi_definition").when(F.col("lang") == "fr", "data_dictionary")
        .otherwise("business_doc").alias("document_type"), none.alias("url"),
        F.col("lang").alias("subject"), none.alias("owner_id"), none.alias("investigation_id"))


# The same text as one chunk per document, for scores SQL can follow.
WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
BUCKETS_SQL = f"""tokens AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{WS}'), lambda x: x <> '')) AS t
  FROM documents),
buckets AS (
  SELECT doc_id, CAST(('0x' || substr(md5(t), 31, 2)) AS INTEGER) AS bucket, count(*) AS n
  FROM tokens GROUP BY ALL),
unit AS (
  SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM buckets)"""


def query_sql(text: str) -> str:
    """A query text's unit vector as a SQL relation ``q(bucket, w)``."""
    from inquest.functions.vectors import text_vector
    rows = ", ".join(f"({b}, {w!r}::DOUBLE)" for b, w in text_vector(text).items())
    return f"q(bucket, w) AS (VALUES {rows})"
