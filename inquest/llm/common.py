"""What the operators of this subpackage share: shared folders, lineage, patterns, SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inquest.session import cut_lineage, shared_folder

# ASCII white space and its complement, as the contracts name them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

TASK_ROWS = 1 << 16       # rows of a narrow table (two numbers a row) that a task takes without need of more

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


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spool(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: compact, and survives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write ``df`` to the shared folder, dealt by ``key``: grouping or joining by it moves nothing."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"inquest_{uuid.uuid4().hex}"
    (df.repartition(parts, key).write.format("parquet").bucketBy(parts, key)
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    out = spark.table(name)
    out.schema                                   # resolved; the files outlive the name
    spark.sql(f"DROP TABLE {name}")
    return out


def few(df: DataFrame) -> DataFrame:
    """A materialised table in a few partitions, for a count or a sum: a task reads many of its files."""
    return df.coalesce(max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """A materialised narrow table of ``rows`` rows in no more partitions than these need.

    What follows then has as many tasks, shuffle files and events as there is work, also where adaptive
    execution may not join small partitions; a table with more rows keeps more partitions.
    """
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def compact(df: DataFrame) -> DataFrame:
    """``fitted`` to its counted rows."""
    return fitted(df, few(df).count())


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def present(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def broadcast_within(df: DataFrame, row_bytes: int, limit: int = 16 << 20) -> DataFrame:
    """Broadcast a materialised side only if its counted rows fit ``limit`` bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


__all__ = ["WORD", "SPACE", "QUERIES", "ORACLES", "query", "table", "spool", "bucketed", "present",
           "few", "fitted", "compact", "unused", "broadcast_within", "cut_lineage", "shared_folder"]
