"""Immutable numbered snapshots of datasets, and their manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from inquest.constants import VERSION_TYPES
from inquest.operators.filters import period_scope
from inquest.sources.readers import read_parquet

MANIFEST_SCHEMA = (
    "version_id string, dataset_id string, parent_version_id string, version_number int, "
    "version_type string, path string, row_count long, column_count int, size_bytes long, "
    "checksum string, operations string, profile string, created_by string, "
    "is_current boolean, created_at timestamp")


def table_checksum(df: DataFrame) -> DataFrame:
    """One row: an order-free fingerprint of a table of any size."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"),
                              F.coalesce(F.sum(hashed), F.lit(0)).cast("string")).alias("checksum"))


def lineage(manifest: DataFrame, version_id: str, scoped_only: bool = False) -> DataFrame:
    """The version and its ancestors; ``steps`` counts parents followed.

    With ``scoped_only`` the walk goes on from scoped slices only, so its last row is
    the nearest version that is not one. ``steps`` ends a walk over a broken manifest.
    """
    view = f"manifest_{uuid.uuid4().hex}"
    manifest.select("version_id", "parent_version_id", "version_type",
                    "version_number").createOrReplaceTempView(view)
    go_on = "AND w.version_type = 'scoped'" if scoped_only else ""
    session = manifest.sparkSession
    try:
        return session.sql(f"""
            WITH RECURSIVE walk AS (
              SELECT version_id, parent_version_id, version_type, version_number, 0 AS steps
              FROM {view} WHERE version_id = :start
              UNION ALL
              SELECT m.version_id, m.parent_version_id, m.version_type, m.version_number, w.steps + 1
              FROM {view} m JOIN walk w ON m.version_id = w.parent_version_id
              WHERE w.steps < 90 {go_on})
            SELECT version_id, parent_version_id, version_type, version_number, min(steps) AS steps
            FROM walk GROUP BY ALL""", {"start": version_id})
    finally:
        session.catalog.dropTempView(view)


def resolve(manifest: DataFrame, dataset_id: str, version_id: str | None = None) -> DataFrame:
    """The named version when it exists, else the dataset's current one."""
    mine = manifest.where(F.col("dataset_id") == dataset_id)
    rank = F.struct((F.col("version_id") == F.lit(version_id or "")).cast("int"),
                    F.col("is_current").cast("int"), F.col("version_number"))
    usable = mine.where(F.col("is_current") | (F.col("version_id") == F.lit(version_id or "")))
    best = usable.agg(F.max_by(F.struct("*"), rank).alias("v"))
    return best.where("v IS NOT NULL").select("v.*")


def list_datasets(manifest: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Versions per dataset, and the current one; with names when a dataset table is given."""
    counts = manifest.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("versions"),
        F.max_by("version_id", F.when(F.col("is_current"), F.col("version_number")))
        .alias("current_version_id"), F.max("version_number").alias("latest_number"))
    if datasets is None:
        return counts
    return datasets.join(counts, "dataset_id", "left").fillna(0, ["versions"])


@dataclass
class VersionStore:
    """Dataset versions as Parquet folders below ``root``, with an append-only manifest."""

    spark: SparkSession
    root: str

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/manifest"

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST_SCHEMA).parquet(self.manifest_path)
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)

    def write(self, df: DataFrame, dataset_id: str, version_type: str = "raw",
              parent: str | None = None, operations: dict | None = None,
              created_by: str = "user", set_current: bool = True, profile: dict | None = None,
              partition_by: list[str] = ()) -> dict:
        """A new version; an existing one is never overwritten."""
        if version_type not in VERSION_TYPES:
            raise ValueError(f"version_type must be one of {VERSION_TYPES}")
        last = self.manifest().where(F.col("dataset_id") == dataset_id).agg(
            F.max("version_number").alias("n")).first()["n"]
        number = (last or 0) + 1
        path = f"{self.root}/data/{dataset_id}/v{number}.parquet"
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
        stored = self.spark.read.parquet(path)
        checksum = table_checksum(stored).first()["checksum"]
        size = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
                .option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length").alias("b"))
                .first()["b"])
        row = {
            "version_id": str(uuid.uuid4()), "dataset_id": dataset_id, "parent_version_id": parent,
            "version_number": number, "version_type": version_type, "path": path,
            "row_count": int(checksum.split(":")[0]), "column_count": len(stored.columns),
            "size_bytes": size, "checksum": checksum,
            "operations": json.dumps(operations, default=str) if operations else None,
            "profile": json.dumps(profile, default=str) if profile else None,
            "created_by": created_by, "is_current": set_current, "created_at": None}
        (self.spark.createDataFrame([row], MANIFEST_SCHEMA)
         .withColumn("created_at", F.current_timestamp()).coalesce(1)
         .write.mode("append").parquet(self.manifest_path))
        return row

    def resolve(self, dataset_id: str, version_id: str | None = None) -> dict:
        found = resolve(self.manifest(), dataset_id, version_id).first()
        if found is None:
            raise ValueError(f"No version of dataset {dataset_id}")
        return found.asDict()

    def load(self, version: dict | str, dataset_id: str | None = None) -> DataFrame:
        if isinstance(version, str):
            version = self.resolve(dataset_id, version)
        return read_parquet(self.spark, version["path"])

    def preview(self, dataset_id: str, version_id: str | None = None, rows: int = 5) -> DataFrame:
        return self.load(self.resolve(dataset_id, version_id)).limit(min(rows, 200))

    def scoped(self, dataset_id: str, start: str | None, end: str | None,
               version_id: str | None = None) -> dict:
        """A version holding one date window, taken from the nearest unscoped ancestor.

        The same window of the same parent is stored once; a window that removes
        nothing is the parent itself.
        """
        version = self.resolve(dataset_id, version_id)
        if not (start or end):
            return version
        base_id = (lineage(self.manifest(), version["version_id"], scoped_only=True)
                   .orderBy(F.desc("steps")).first()["version_id"])
        base = self.resolve(dataset_id, base_id)
        operations = {"operation": "period_scope", "scope_start": start, "scope_end": end,
                      "parent_version": base_id}
        same = self.manifest().where(
            (F.col("dataset_id") == dataset_id) & (F.col("version_type") == "scoped")
            & F.col("operations").isNotNull()
            & F.get_json_object("operations", "$.scope_start").eqNullSafe(F.lit(start))
            & F.get_json_object("operations", "$.scope_end").eqNullSafe(F.lit(end))
            & (F.get_json_object("operations", "$.parent_version") == base_id)).first()
        if same is not None:
            return same.asDict()
        part = period_scope(self.load(base), start, end)
        if part.count() == base["row_count"]:
            return base
        return self.write(part, dataset_id, "scoped", base_id, operations, "scope", set_current=False)
