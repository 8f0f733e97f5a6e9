"""Reading tables and documents, and recording where they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from inquest.constants import (CONTENT_MARKERS, DOCUMENT_SUFFIXES, JDBC_BANNED,
                               TABULAR_SUFFIXES)
from inquest.functions.tables import nan_to_null
from inquest.operators.filters import guard_sql


def zoned(df: DataFrame) -> DataFrame:
    """Timestamps without a zone are read in the session's zone, once, at the source."""
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp").alias(f.name)
                       if isinstance(f.dataType, T.TimestampNTZType) else F.col(f"`{f.name}`")
                       for f in df.schema])


def read_csv(spark: SparkSession, path, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Header row and inferred types; give a schema to save the inference pass."""
    reader = spark.read.option("header", True).option("sep", sep)
    # days stay text here: a date column may hold anything else as well
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True).option(
        "prefersDate", False)
    return zoned(nan_to_null(reader.csv(path)))


def read_json(spark: SparkSession, path, schema: str | None = None,
              lines: bool = False) -> DataFrame:
    """An array of records per file, or one record per line with ``lines``.

    Only the second form can be split over tasks.
    """
    reader = spark.read.option("multiLine", not lines)
    return zoned(nan_to_null((reader.schema(schema) if schema else reader).json(path)))


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return zoned(nan_to_null(spark.read.parquet(path)))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Dispatch on the file suffix."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".csv"):
        return read_csv(spark, path, schema)
    if lowered.endswith((".tsv", ".tab")):
        return read_csv(spark, path, schema, sep="\t")
    if lowered.endswith((".json", ".jsonl")):
        return read_json(spark, path, schema, lines=lowered.endswith(".jsonl"))
    if lowered.endswith(".parquet"):
        return read_parquet(spark, path)
    raise ValueError(f"Not a supported table format: {path}")


def read_jdbc(spark: SparkSession, url: str, query: str, limit: int | None = None,
              **options) -> DataFrame:
    """One guarded SELECT; a limit, if given, holds inside the database."""
    text = guard_sql(query, JDBC_BANNED, ("select",))
    return (spark.read.format("jdbc").options(**options).option("url", url)
            .option("query", f"SELECT * FROM ({text}) AS sub"
                    + ("" if limit is None else f" LIMIT {int(limit)}")).load())


def jdbc_origin(url: str) -> str:
    """The part of a connection URL that carries no credentials."""
    return url.split("@")[-1] if "@" in url else "database"


def read_documents(spark: SparkSession, path) -> DataFrame:
    """``path``, ``suffix`` and ``text``: one row per whole text, Markdown or HTML file."""
    name = F.input_file_name()
    return spark.read.text(path, wholetext=True).select(
        name.alias("path"), suffix_of(name).alias("suffix"), F.col("value").alias("text"))


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def content_suffix(url: Column, content_type: Column) -> Column:
    """Content type first, then the path's suffix, else HTML."""
    lowered = F.lower(F.coalesce(content_type, F.lit("")))
    known = None
    for marker, suffix in CONTENT_MARKERS:
        hit = lowered.contains(marker)
        known = F.when(hit, suffix) if known is None else known.when(hit, suffix)
    path = suffix_of(F.regexp_replace(url, r"[?#].*$", ""))
    bare_host = F.regexp_replace(url, r"[?#].*$", "").rlike(r"^[a-zA-Z]+://[^/]*$")
    return F.coalesce(known, F.when(path.isin(*DOCUMENT_SUFFIXES, ".csv") & ~bare_host, path),
                      F.lit(".html"))


def source_kind(suffix: Column) -> Column:
    return (F.when(suffix.isin(*TABULAR_SUFFIXES), "tabular")
            .when(suffix.isin(*DOCUMENT_SUFFIXES), "document"))


def register_files(spark: SparkSession, path, owner: str | None = None,
                   retrieved_at: str | None = None) -> DataFrame:
    """Provenance rows of raw files: name, size, SHA-256 and kind, before any parsing."""
    raw = spark.read.format("binaryFile").load(path)
    suffix = suffix_of(F.col("path"))
    when = F.lit(retrieved_at).cast("timestamp") if retrieved_at else F.current_timestamp()
    return raw.select(
        F.sha2(F.concat_ws("|", "path", F.sha2("content", 256)), 256).alias("source_id"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.lit("file").alias("source_type"), suffix.alias("source_format"),
        source_kind(suffix).alias("kind"), F.col("path").alias("origin"),
        F.sha2("content", 256).alias("checksum"), F.col("length").alias("size_bytes"),
        when.alias("retrieved_at"), F.lit(owner).alias("owner_id"),
        F.lit("registered").alias("status"), F.lit(False).alias("is_deleted"))


def register_pages(pages: DataFrame, url: str = "url", content: str = "html",
                   content_type: Column | None = None, owner: str | None = None) -> DataFrame:
    """Provenance rows of stored web pages."""
    suffix = content_suffix(F.col(url), content_type if content_type is not None else F.lit(None).cast("string"))
    return pages.select(
        F.sha2(F.concat_ws("|", F.col(url), F.sha2(F.col(content), 256)), 256).alias("source_id"),
        F.col(url).alias("name"), F.lit("url").alias("source_type"),
        suffix.alias("source_format"), source_kind(suffix).alias("kind"),
        F.col(url).alias("origin"), F.sha2(F.col(content), 256).alias("checksum"),
        F.octet_length(F.col(content)).cast("long").alias("size_bytes"),
        F.lit(owner).alias("owner_id"), F.lit("registered").alias("status"),
        F.lit(False).alias("is_deleted"))


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.where(~F.col("is_deleted")).select(
        "source_id", "name", "source_type", "source_format", "status")
