"""Append-only record tables: tool runs, findings, reports, feedback and the like."""

from __future__ import annotations

import datetime as dt
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inquest.constants import FINDING_TYPES, REQUEST_TYPES

PREDICTION = "array<struct<period:string,point:double,lower:double,upper:double>>"
SCHEMAS = {
    "investigations": "id string, question string, dataset_id string, version_id string, "
                      "target_metric string, owner_id string, status string, round int",
    "tool_runs": "id string, investigation_id string, tool_name string, agent string, "
                 "parameters string, result string, status string, error string, "
                 "duration_ms long, result_checksum string",
    "findings": "id string, investigation_id string, hypothesis_id string, tool_run_id string, "
                "statement string, evidence_summary string, finding_type string, "
                "magnitude double, unit string, confidence string, verification_status string, "
                "caveats string",
    "hypotheses": "id string, investigation_id string, statement string, columns array<string>, "
                  "proposed_test string, status string, confidence double, reasoning string",
    "requests": "id string, investigation_id string, hypothesis_id string, request_type string, "
                "question string, reason string, status string, response string",
    "forecasts": "id string, investigation_id string, finding_id string, target_metric string, "
                 f"model_name string, reliability string, withheld_reason string, predictions {PREDICTION}, "
                 "mape double, naive_mape double, folds int",
    "recommendations": "id string, investigation_id string, finding_id string, `rank` int, "
                       "action string, rationale string, impact_low double, impact_high double, "
                       "unit string, impact_method string, confidence string, urgency string, "
                       "user_decision string",
    "reports": "id string, investigation_id string, version_number int, title string, "
               "executive_summary string, content string, status string",
    "feedback": "id string, target_type string, target_id string, rating int, "
                "was_adopted boolean, comment string",
    "snapshots": "id string, investigation_id string, version_id string, metric string, "
                 "dimension string, `group` string, value double",
    "comparisons": "id string, investigation_id string, previous_id string, driver_change string, "
                   "summary string",
    "documents": "id string, source_id string, owner_id string, title string, "
                 "document_type string, text string, url string, subject string",
    "sources": "id string, name string, source_type string, source_format string, origin string, "
               "checksum string, size_bytes long, owner_id string, status string, is_deleted boolean",
    "datasets": "id string, name string, source_id string, owner_id string, "
                "sensitive_columns array<string>",
    "deleted": "id string, table string",
}
# What goes with a deleted row: child table -> column naming its parent.
CHILDREN = {
    "investigations": {t: "investigation_id" for t in (
        "tool_runs", "findings", "hypotheses", "requests", "forecasts", "recommendations",
        "reports", "snapshots", "comparisons")},
    "recommendations": {"feedback": "target_id"},
}


def without_deleted(table: DataFrame, deleted: DataFrame, name: str) -> DataFrame:
    gone = deleted.where(F.col("table") == name).select("id")
    return table.join(gone, "id", "left_anti")


def latest(table: DataFrame, key: str = "id", order: str = "recorded_at") -> DataFrame:
    """The newest row of every key: a later append is an update."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return table.withColumn("k_", F.row_number().over(newest)).where("k_ = 1").drop("k_")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing rows with the same keys."""
    a, b = existing.alias("a"), incoming.select(*keys).distinct().alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left_anti").unionByName(incoming)


@dataclass
class RecordStore:
    """One Parquet folder per record type below ``root``."""

    spark: SparkSession
    root: str
    pending: dict | None = None

    def _path(self, name: str) -> str:
        return f"{self.root}/records/{name}"

    @contextmanager
    def batch(self):
        """Hold back appended rows and write each table once at the end.

        For one investigation, whose rows are tens; reads see them at once.
        """
        if self.pending is not None:
            yield
            return
        self.pending = {}
        try:
            yield
        finally:
            held, self.pending = self.pending, None
            for name, rows in held.items():
                self._frame(name, rows).coalesce(1).write.mode("append").parquet(self._path(name))

    def _frame(self, name: str, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name] + ", recorded_at timestamp")

    def append(self, name: str, rows: list[dict]) -> list[dict]:
        rows = [{"id": str(uuid.uuid4()), **r} for r in rows]
        if rows and self.pending is not None:
            self.pending.setdefault(name, []).extend(
                r | {"recorded_at": dt.datetime.now(dt.timezone.utc)} for r in rows)
        elif rows:
            frame = self.spark.createDataFrame(rows, SCHEMAS[name])
            self.append_frame(name, frame)
        return rows

    def append_frame(self, name: str, frame: DataFrame) -> None:
        (frame.withColumn("recorded_at", F.current_timestamp())
         .write.mode("append").parquet(self._path(name)))

    def read(self, name: str) -> DataFrame:
        """Current rows: newest per id, without deleted ones."""
        schema = SCHEMAS[name] + ", recorded_at timestamp"
        try:
            table = self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException:
            table = self.spark.createDataFrame([], schema)
        held = (self.pending or {}).get(name)
        if held:
            table = table.unionByName(self._frame(name, held))
        if name == "deleted":
            return table
        return without_deleted(latest(table), self.read("deleted"), name)

    def update(self, name: str, key: str, **changes) -> None:
        held = [r for r in (self.pending or {}).get(name, []) if r["id"] == key]
        if held:
            row = {k: v for k, v in held[-1].items() if k != "recorded_at"}
        else:
            found = self.read(name).where(F.col("id") == key).drop("recorded_at").first()
            if found is None:
                raise ValueError(f"No row {key} in {name}")
            row = found.asDict(recursive=True)
        self.append(name, [row | changes])

    def delete(self, name: str, key: str) -> None:
        """Delete a row, everything below it, and the report documents indexed for it."""
        if name == "sources":
            used = self.read("datasets").where(F.col("source_id") == key)
            if not used.isEmpty():
                raise ValueError("The source is in use by a dataset")
        gone = self.spark.createDataFrame([(key, name)], SCHEMAS["deleted"])
        for child, column in CHILDREN.get(name, {}).items():
            rows = self.read(child).where(F.col(column) == key)
            gone = gone.unionByName(rows.select("id", F.lit(child).alias("table")))
            for leaf, link in CHILDREN.get(child, {}).items():
                below = self.read(leaf).join(rows.select(F.col("id").alias(link)), link, "left_semi")
                gone = gone.unionByName(below.select("id", F.lit(leaf).alias("table")))
            if child == "reports":
                docs = self.read("documents").join(
                    rows.select(F.col("id").alias("source_id")), "source_id", "left_semi")
                gone = gone.unionByName(docs.select("id", F.lit("documents").alias("table")))
        self.append_frame("deleted", gone)

    # --- guarded appends ---------------------------------------------------

    def save_finding(self, **values) -> dict:
        if values.get("finding_type", "measurement") not in FINDING_TYPES:
            raise ValueError(f"finding_type must be one of {FINDING_TYPES}")
        base = {"finding_type": "measurement", "confidence": "medium",
                "verification_status": "pending"}
        return self.append("findings", [base | values])[0]

    def save_recommendation(self, **values) -> dict:
        if values.get("finding_id"):
            found = self.read("findings").where(F.col("id") == values["finding_id"]).first()
            if found is None:
                raise ValueError(f"No finding {values['finding_id']}")
            if found["verification_status"] != "verified":
                raise ValueError("A finding that is not verified cannot carry a recommendation")
        base = {"impact_method": "given by the caller; assumptions not recorded",
                "confidence": "medium", "urgency": "medium"}
        return self.append("recommendations", [base | values])[0]

    def save_report(self, **values) -> dict:
        of = values["investigation_id"]
        if self.read("investigations").where(F.col("id") == of).isEmpty():
            raise ValueError(f"No investigation {of}")
        number = self.read("reports").where(F.col("investigation_id") == of).count() + 1
        return self.append("reports", [{"status": "final"} | values | {"version_number": number}])[0]

    def request_evidence(self, **values) -> dict:
        if values.get("request_type", "clarification") not in REQUEST_TYPES:
            raise ValueError(f"request_type must be one of {REQUEST_TYPES}")
        self.update("investigations", values["investigation_id"], status="awaiting_user")
        base = {"request_type": "clarification", "status": "open"}
        return self.append("requests", [base | values])[0]

    def record_feedback(self, recommendation_id: str, verdict: str, comment: str | None = None) -> dict:
        """``useful`` rates 5 and adopts, ``not_useful`` rates 1 and rejects."""
        scores = {"useful": (5, True, "accepted"), "not_useful": (1, False, "rejected")}
        if verdict not in scores:
            raise ValueError(f"verdict must be one of {sorted(scores)}")
        rating, adopted, decision = scores[verdict]
        self.update("recommendations", recommendation_id, user_decision=decision)
        return self.append("feedback", [{
            "target_type": "recommendation", "target_id": recommendation_id, "rating": rating,
            "was_adopted": adopted, "comment": comment}])[0]

    def export(self, investigation_id: str, folder: str) -> None:
        """The evidence behind an investigation as JSON, one folder per record type."""
        for name, column in CHILDREN["investigations"].items():
            (self.read(name).where(F.col(column) == investigation_id)
             .write.mode("errorifexists").json(f"{folder}/{name}"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The highest report version of every investigation."""
    newest = Window.partitionBy("investigation_id").orderBy(F.desc("version_number"))
    return reports.withColumn("k_", F.row_number().over(newest)).where("k_ = 1").drop("k_")


def evidence_table(findings: DataFrame, tool_runs: DataFrame) -> DataFrame:
    """Findings with the tool run each rests on, if any."""
    runs = tool_runs.select(F.col("id").alias("tool_run_id"), "tool_name", "parameters",
                            F.col("status").alias("run_status"), "duration_ms", "result_checksum")
    return findings.join(runs, "tool_run_id", "left")
