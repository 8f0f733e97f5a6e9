"""The named tools of a workspace: every call is timed, logged and can be re-run."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import time
import uuid
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inquest.constants import DOCUMENT_SUFFIXES, RETURNED_SQL_ROWS, TABULAR_SUFFIXES
from inquest.operators import (cleaning, contribution, drift, drivers, forecasting, pages, profiling,
                               retrieval, stattests, summaries)
from inquest.operators.filters import check_operation, readonly_sql, visible
from inquest.session import cut_lineage
from inquest.sources import readers
from inquest.sources.records import RecordStore, upsert
from inquest.sources.versions import VersionStore, table_checksum


@dataclass
class Workspace:
    """Datasets, records and the document index below one folder."""

    spark: SparkSession
    root: str
    held: dict = field(default_factory=dict)

    def __post_init__(self):
        self.versions = VersionStore(self.spark, self.root)
        self.records = RecordStore(self.spark, self.root)

    def table(self, dataset_id: str, version_id: str | None = None) -> DataFrame:
        version = self.versions.resolve(dataset_id, version_id)
        return self.held.get(version["version_id"]) or self.versions.load(version)

    def hold(self, version: dict) -> DataFrame:
        """Keep a version's rows at hand while several tools read it."""
        df = self.versions.load(version).persist(StorageLevel.MEMORY_AND_DISK)
        self.held[version["version_id"]] = df
        return df

    def release(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()

    # --- document index ----------------------------------------------------

    def chunks(self) -> DataFrame:
        schema = ("document_id string, title string, document_type string, owner_id string, "
                  "url string, subject string, investigation_id string, chunk_index int, "
                  "content string, chunk_id string, vector array<float>, norm double, "
                  "embedding string, token_count int, indexed_at timestamp")
        try:
            stored = self.spark.read.schema(schema).parquet(f"{self.root}/chunks")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        live = self.records.read("documents").select(F.col("id").alias("document_id"))
        return stored.join(live, "document_id", "left_semi")

    def index(self, docs: DataFrame) -> None:
        """Store documents and their chunks. Needs ``document_id``, ``title`` and ``text``."""
        for c in ("document_type", "owner_id", "url", "subject", "source_id", "investigation_id"):
            if c not in docs.columns:
                docs = docs.withColumn(c, F.lit("business_doc" if c == "document_type" else None)
                                       .cast("string"))
        kept = retrieval.stored_documents(docs)
        self.records.append_frame("documents", kept.select(
            F.col("document_id").alias("id"), "source_id", "owner_id", "title", "document_type",
            "text", "url", "subject"))
        columns = ["document_id", "title", "document_type", "owner_id", "url", "subject",
                   "investigation_id", "text"]
        (retrieval.index_documents(docs.select(*columns)).withColumn("indexed_at", F.current_timestamp())
         .write.mode("append").parquet(f"{self.root}/chunks"))

    def replace_pages(self, docs: DataFrame) -> None:
        """Index web pages; one already stored for the same owner and address is replaced."""
        old = (self.records.read("documents").where(F.col("document_type") == "web_page").alias("o")
               .join(docs.select("url", "owner_id").distinct().alias("n"),
                     (F.col("o.url") == F.col("n.url"))
                     & F.col("o.owner_id").eqNullSafe(F.col("n.owner_id")), "left_semi"))
        gone = cut_lineage(old.select("id", F.lit("documents").alias("table")))     # before new ones come
        self.index(docs)
        self.records.append_frame("deleted", gone)


# --- results -----------------------------------------------------------------

def plain(value):
    """A JSON value. Numbers keep nine digits, so that the order of a sum does not show."""
    if isinstance(value, float):
        return float(f"{value:.9g}") if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def checksum(value) -> str:
    return hashlib.sha256(json.dumps(plain(value), sort_keys=True, default=str).encode()).hexdigest()


def frame_result(df: DataFrame) -> dict:
    """A result table: all rows when there are few, else a page of them and a fingerprint of all."""
    rows = [r.asDict(recursive=True) for r in df.limit(RETURNED_SQL_ROWS + 1).collect()]
    result = {"columns": df.columns, "rows": plain(rows[:RETURNED_SQL_ROWS])}
    if len(rows) <= RETURNED_SQL_ROWS:
        return result | {"row_count": len(rows)}
    # nine digits of a number, as on the page
    steady = df.select(*[F.format_string("%.8e", F.col(f"`{f.name}`").cast("double")).alias(f.name)
                         if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
                         for f in df.schema])
    mark = table_checksum(steady).first()["checksum"]
    return result | {"row_count": int(mark.split(":")[0]), "fingerprint": mark}


# --- tools -------------------------------------------------------------------

def inspect_dataset(ws: Workspace, dataset_id: str, version_id: str | None = None, rows: int = 5) -> dict:
    df = ws.table(dataset_id, version_id)
    return {"schema": {f.name: f.dataType.simpleString() for f in df.schema},
            "row_count": df.count(), **frame_result(df.limit(min(rows, 200)))}


def profile_columns(ws: Workspace, dataset_id: str, version_id: str | None = None,
                    now: str | None = None, sensitive: list[str] = ()) -> dict:
    import datetime as dt
    moment = dt.datetime.fromisoformat(now) if now else None
    p = profiling.profile(ws.table(dataset_id, version_id), moment, sensitive)
    return plain({"row_count": p.row_count, "columns": p.columns, "dataset_issues": p.dataset_issues,
                  "issue_counts": p.issue_counts, "health_score": p.health})


def run_dataframe_code(ws: Workspace, dataset_id: str, operation: str, params: dict | None = None,
                       version_id: str | None = None) -> dict:
    check_operation(operation)
    df, p = ws.table(dataset_id, version_id), params or {}
    if operation == "describe":
        out = summaries.describe(df, p.get("columns"))
    elif operation == "value_counts":
        out = summaries.value_counts(df, p["column"], int(p.get("limit", 20)))
    elif operation == "groupby_aggregate":
        out = summaries.groupby_aggregate(df, p["by"], p["metric"], p.get("agg", "sum"))
    elif operation == "correlation":
        out = summaries.correlation(df, p.get("columns"))
    elif operation == "time_series":
        out = summaries.time_series(df, p["date_column"], p["metric"], p.get("freq", "M"),
                                    p.get("agg", "sum"))
    elif operation == "interaction_contribution":
        out = contribution.interaction_contribution(df, p["date_column"], p["metric"], p["by"],
                                                    p.get("split"))
    else:
        return _contribution(df, p)
    return {"operation": operation, **frame_result(out)}


def _contribution(df: DataFrame, p: dict) -> dict:
    """Contributions of one or several columns, each leader's season and the intervals."""
    date, metric = p["date_column"], p["metric"]
    dims = [p["by"]] if isinstance(p["by"], str) else list(p["by"])
    split = contribution.resolve_split(df, date, metric, p.get("split"))
    table = contribution.period_contribution(df, date, metric, dims, split)
    if p.get("top"):                       # each column's leading groups, however many it has
        order = Window.partitionBy("dimension").orderBy(
            F.desc("contribution_to_total_change_pct"), "group")
        table = table.withColumn("place_", F.row_number().over(order)).where(
            F.col("place_") <= int(p["top"])).drop("place_").orderBy(
            "dimension", F.desc("contribution_to_total_change_pct"), "group")
    if p.get("intervals", True):
        bands = contribution.contribution_intervals(df, date, metric, dims, split)
        table = table.join(bands.select("dimension", "group", "low", "high"),
                           ["dimension", "group"], "left").orderBy(
            "dimension", F.desc("contribution_to_total_change_pct"), "group")
    result = {"operation": "period_contribution", **frame_result(table)}
    leads: dict[str, str] = {}
    for d in dims:
        row = contribution.leading_group(table, d) if "fingerprint" in result else next(
            (r for r in result["rows"] if r["dimension"] == d), None)
        if row:
            leads[d] = row["group"]
    checks = contribution.seasonal_check(df, date, metric, dims, str(split.cutoff), leads)
    seasons = {r["dimension"]: plain(r.asDict()) for r in checks.collect()} if leads else {}
    return result | {"seasonality": seasons, "split_date": split.date, "split_method": split.method,
                     "split_strength": plain(split.strength)}


def run_readonly_sql(ws: Workspace, dataset_id: str, query: str, version_id: str | None = None) -> dict:
    return frame_result(readonly_sql(ws.table(dataset_id, version_id), query))


def run_statistical_test(ws: Workspace, dataset_id: str, test: str, params: dict,
                         version_id: str | None = None) -> dict:
    return plain(stattests.statistical_test(ws.table(dataset_id, version_id), test, **params))


def render_chart(ws: Workspace, dataset_id: str, spec: dict, version_id: str | None = None) -> dict:
    """The data behind a picture."""
    df, kind = ws.table(dataset_id, version_id), spec.get("type", "bar")
    if kind == "bar":
        out = summaries.bar_frame(df, spec["x"], spec["y"], spec.get("agg", "sum"))
    elif kind == "line":
        out = summaries.line_frame(df, spec["x"], spec["y"], spec.get("freq", "M"), spec.get("agg", "sum"))
    elif kind == "hist":
        out = summaries.histogram(df, spec["column"], int(spec.get("bins", 30)))
    elif kind == "scatter":
        out = summaries.scatter_frame(df, spec["x"], spec["y"])
    elif kind == "forecast":
        series = summaries.build_series(df, spec["x"], spec["y"], spec.get("freq", "M"))
        out = forecasting.chart_frame(series, forecasting.forecast(series, [], spec.get("horizon", 3)))
    else:
        raise ValueError(f"Unknown chart type: {kind}")
    return {"type": kind, **frame_result(out)}


def run_forecast(ws: Workspace, dataset_id: str, date_column: str, metric: str, horizon: int = 3,
                 freq: str = "M", agg: str = "sum", filters: dict | None = None,
                 version_id: str | None = None, external_features: list[str] | None = None,
                 use_external_features: bool = True, by: list[str] = ()) -> dict:
    return frame_result(forecasting.run_forecast(
        ws.table(dataset_id, version_id), date_column, metric, horizon, freq, agg, filters, by,
        external_features, use_external_features))


def vector_search(ws: Workspace, query: str, top_k: int = 5, document_type=None) -> dict:
    return {"query": query, **frame_result(retrieval.search(ws.chunks(), query, top_k, document_type)
                                           .drop("indexed_at"))}


def get_business_definition(ws: Workspace, term: str) -> dict:
    row = retrieval.definitions(ws.chunks(), [term]).first()
    return plain(row.asDict()) if row else {"term": term, "definition": None}


def list_sources(ws: Workspace, user: str | None = None, admin: bool = True) -> dict:
    mine = visible(ws.records.read("sources"), user, admin)
    return frame_result(mine.select("id", "name", "source_type", "source_format", "status")
                        .orderBy("name", "id"))


def ingest_source(ws: Workspace, filename: str, content_base64: str, owner_id: str | None = None) -> dict:
    """Store one small uploaded file with its provenance; a table also becomes a dataset."""
    content = base64.b64decode(content_base64, validate=True)
    suffix = PurePosixPath(filename).suffix.lower()
    if suffix not in TABULAR_SUFFIXES + DOCUMENT_SUFFIXES:
        raise ValueError(f"Unsupported file type: {suffix}")
    mark = hashlib.sha256(content).hexdigest()
    source = ws.records.append("sources", [{
        "name": filename, "source_type": "file", "source_format": suffix, "origin": filename,
        "checksum": mark, "size_bytes": len(content), "owner_id": owner_id, "status": "registered",
        "is_deleted": False}])[0]
    folder = f"{ws.root}/sources/{source['id']}"
    text = content.decode("utf-8", "ignore")
    ws.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder, lineSep="\n")
    result = {"source_id": source["id"], "checksum": mark, "size_bytes": len(content)}
    if suffix not in TABULAR_SUFFIXES:
        return result | {"kind": "document", "path": folder}
    loaders = {".csv": lambda: readers.read_csv(ws.spark, folder),
               ".tsv": lambda: readers.read_csv(ws.spark, folder, sep="\t"),
               ".json": lambda: readers.read_json(ws.spark, folder)}
    if suffix not in loaders:
        raise ValueError(f"Read {suffix} files from storage instead of uploading them")
    dataset = ws.records.append("datasets", [{"name": filename, "source_id": source["id"],
                                              "owner_id": owner_id}])[0]
    version = ws.versions.write(loaders[suffix](), dataset["id"], "raw")
    return result | {"kind": "dataset", "dataset_id": dataset["id"], "version_id": version["version_id"]}


def extract_document(ws: Workspace, source_id: str, document_type: str = "business_doc") -> dict:
    source = ws.records.read("sources").where(F.col("id") == source_id).first()
    if source is None:
        raise ValueError(f"No source {source_id}")
    text = readers.read_documents(ws.spark, f"{ws.root}/sources/{source_id}").select("text")
    if source["source_format"] in (".html", ".htm"):
        text = text.select(pages.page_text(F.col("text")).alias("text"))
    doc = text.select(F.lit(f"doc-{source_id}").alias("document_id"), F.lit(source["name"]).alias("title"),
                      "text", F.lit(document_type).alias("document_type"),
                      F.lit(source_id).alias("source_id"),
                      F.lit(source["owner_id"]).cast("string").alias("owner_id"))
    ws.index(doc)
    ws.records.update("sources", source_id, status="extracted")
    made = ws.chunks().where(F.col("document_id") == f"doc-{source_id}").count()
    return {"document_id": f"doc-{source_id}", "title": source["name"], "chunks": made}


def fetch_url(ws: Workspace, url: str, pages_path: str, owner_id: str | None = None,
              max_pages: int = 25, max_depth: int = 3, subject: str | None = None) -> dict:
    """Index the stored pages of one site that can be reached from an address."""
    stored = ws.spark.read.parquet(pages_path)
    walked = uuid.uuid4().hex              # one for the walk: a task that runs again names pages alike
    walk = pages.reachable_pages(stored, url, max_pages, max_depth)
    texts = pages.page_documents(stored).withColumn("url", pages.without_fragment(F.col("url")))
    docs = (texts.join(F.broadcast(walk.select("url")), "url", "left_semi")
            .groupBy("url").agg(F.min(F.struct("title", "text")).alias("p"))
            .select(F.concat(F.lit("page-"), F.sha2(F.concat_ws("|", "url", F.lit(owner_id), F.lit(walked)), 256))
                    .alias("document_id"), "url", "p.title", "p.text",
                    F.lit("web_page").alias("document_type"),
                    F.lit(owner_id).cast("string").alias("owner_id"),
                    F.lit(subject).cast("string").alias("subject")))
    ws.replace_pages(docs)
    return frame_result(walk)


def apply_cleaning_plan(ws: Workspace, dataset_id: str, approved_op_ids: list[str] = (),
                        version_id: str | None = None) -> dict:
    """Clean a version into a new one and compare their health."""
    parent = ws.versions.resolve(dataset_id, version_id)
    df = ws.table(dataset_id, parent["version_id"])
    before = profiling.profile(df, anomalies=False).health
    cleaned, log = cleaning.apply_plan(df, cleaning.propose_plan(df), approved_op_ids)
    done = [{"op_id": o.op_id, "executed": o.executed, "skipped": o.skipped, "affected": o.affected}
            for o in log.operations]
    version = ws.versions.write(cleaned, dataset_id, "cleaned", parent["version_id"],
                                {"operations": done}, "cleaning")
    after = profiling.profile(ws.versions.load(version), anomalies=False).health
    return plain({"version_id": version["version_id"], "version_number": version["version_number"],
                  "operations": done, "health_before": before, "health_after": after})


def detect_drift(ws: Workspace, dataset_id: str, from_version: str | None = None,
                 to_version: str | None = None) -> dict:
    numbered = (ws.versions.manifest().where(F.col("dataset_id") == dataset_id)
                .orderBy(F.desc("version_number")).limit(2).collect())
    if len(numbered) < 2 and not (from_version and to_version):
        raise ValueError("This dataset has only one version")
    later = ws.versions.resolve(dataset_id, to_version) if to_version else numbered[0].asDict()
    earlier = ws.versions.resolve(dataset_id, from_version) if from_version else numbered[1].asDict()
    a, b = ws.versions.load(earlier), ws.versions.load(later)
    table = drift.detect_drift(a, b)
    return {"from_version": earlier["version_number"], "to_version": later["version_number"],
            "verdict": drift.verdict(table).first()["verdict"],
            "schema": plain([r.asDict() for r in drift.schema_changes(a, b).where("change <> 'same'").collect()]),
            **frame_result(table)}


def save_finding(ws: Workspace, **values) -> dict:
    return {"finding_id": ws.records.save_finding(**values)["id"]}


def save_recommendation(ws: Workspace, **values) -> dict:
    return {"recommendation_id": ws.records.save_recommendation(**values)["id"]}


def save_report(ws: Workspace, **values) -> dict:
    row = ws.records.save_report(**values)
    index_report(ws, row["id"])
    return {"report_id": row["id"], "version": row["version_number"]}


def index_report(ws: Workspace, report_id: str) -> None:
    """Make a report retrievable by later investigations."""
    body = "findings array<struct<statement:string,evidence_summary:string>>, actions array<string>"
    r = ws.records.read("reports").where(F.col("id") == report_id).alias("r")
    inv = ws.records.read("investigations").alias("i")
    rows = r.join(inv, F.col("r.investigation_id") == F.col("i.id")).select(
        F.col("r.id").alias("id"), F.col("i.question").alias("question"),
        F.col("i.target_metric").alias("target_metric"), "r.executive_summary",
        F.col("i.owner_id").alias("owner_id"), F.col("r.investigation_id").alias("investigation_id"),
        F.from_json(F.coalesce("r.content", F.lit("{}")), body).alias("c"))
    none = F.array()
    rows = rows.select("*", F.coalesce("c.findings", none.cast(
        "array<struct<statement:string,evidence_summary:string>>")).alias("findings"),
        F.coalesce("c.actions", none.cast("array<string>")).alias("actions"))
    ws.index(retrieval.report_document(rows).withColumn("source_id", F.lit(report_id)))


def request_missing_evidence(ws: Workspace, **values) -> dict:
    row = ws.records.request_evidence(**values)
    return {"request_id": row["id"], "investigation_status": "awaiting_user"}


def generate_recommendations(ws: Workspace, investigation_id: str, require_verified: bool = True) -> dict:
    """Ranked actions for the investigation's verified drivers; stored and returned."""
    mine = F.col("investigation_id") == investigation_id
    findings = ws.records.read("findings").where(mine)
    statements = [r["statement"] for r in drivers.eligible(findings, require_verified).collect()]
    feedback = drivers.past_feedback(
        ws.records.read("feedback"), ws.records.read("recommendations"), ws.records.read("findings"),
        statements) if statements else None
    made = [r.asDict() for r in drivers.recommendations(
        findings, ws.records.read("forecasts").where(mine), feedback, require_verified)
        .orderBy("rank").collect()]
    keep = ("investigation_id", "finding_id", "rank", "action", "rationale", "impact_low",
            "impact_high", "unit", "impact_method", "confidence", "urgency")
    stored = ws.records.append("recommendations", [{k: r[k] for k in keep} for r in made])
    return plain({"count": len(stored), "recommendations": stored})


def compare_investigations(ws: Workspace, current_id: str, previous: int = 3) -> dict:
    rows = drivers.compare_investigations(ws.records.read("investigations"), ws.records.read("findings"),
                                          current_id, previous).collect()
    ws.records.append("comparisons", [{
        "investigation_id": current_id, "previous_id": r["previous_id"],
        "driver_change": r["driver_change"],
        "summary": f"before: {r['previous_drivers'] or 'none'}; now: {r['current_drivers'] or 'none'}"}
        for r in rows])
    return plain({"compared_with": len(rows), "comparisons": [r.asDict() for r in rows]})


def resume_investigation(ws: Workspace, investigation_id: str, request_id: str, response: str,
                         extra: DataFrame | None = None) -> dict:
    from inquest.plans.investigate import resume
    return resume(ws, investigation_id, request_id, response, extra)


TOOLS = {f.__name__: f for f in (
    inspect_dataset, profile_columns, run_dataframe_code, run_readonly_sql, run_statistical_test,
    render_chart, run_forecast, vector_search, get_business_definition, list_sources, ingest_source,
    extract_document, fetch_url, apply_cleaning_plan, save_finding, generate_recommendations,
    save_recommendation, save_report, request_missing_evidence, resume_investigation,
    compare_investigations, detect_drift)}


def call_tool(ws: Workspace, name: str, params: dict, investigation_id: str | None = None,
              agent: str | None = None) -> tuple[dict, dict]:
    """The tool's result and the logged run. A failing tool is a row, not an exception."""
    if name not in TOOLS:
        raise ValueError(f"Unknown tool: {name}. Use one of {sorted(TOOLS)}")
    begun = time.perf_counter()
    run = {"investigation_id": investigation_id, "tool_name": name, "agent": agent,
           "parameters": json.dumps(plain(params), sort_keys=True), "status": "success",
           "error": None, "result_checksum": None}
    try:
        result = TOOLS[name](ws, **params)
        run["result_checksum"] = checksum(result)
    except (ValueError, KeyError, TypeError, PySparkException) as error:
        result = {"error": str(error).split("\n")[0]}
        run |= {"status": "error", "error": result["error"]}
    run["result"] = json.dumps(plain(result), sort_keys=True, default=str)
    run["duration_ms"] = int((time.perf_counter() - begun) * 1000)
    return result, ws.records.append("tool_runs", [run])[0]


def reverify(ws: Workspace, run: dict) -> dict:
    """Run a recorded call again; equal checksums mean the result stands."""
    if run["status"] != "success":
        return {"verified": False, "reason": "the recorded run failed"}
    try:
        fresh = checksum(TOOLS[run["tool_name"]](ws, **json.loads(run["parameters"])))
    except (ValueError, KeyError, TypeError, PySparkException) as error:
        return {"verified": False, "reason": f"the re-run failed: {error}"}
    return {"verified": fresh == run["result_checksum"], "recomputed_checksum": fresh}


def verify_findings(ws: Workspace, investigation_id: str) -> dict[str, bool]:
    """Re-run every calculation behind the findings, each recorded call once."""
    mine = F.col("investigation_id") == investigation_id
    runs = {r["id"]: r.asDict() for r in ws.records.read("tool_runs").where(mine).collect()}
    findings = [r.asDict() for r in ws.records.read("findings").where(mine).drop("recorded_at").collect()]
    needed = {f["tool_run_id"] for f in findings if f["tool_run_id"] in runs}
    stands = {i: reverify(ws, runs[i])["verified"] for i in needed}
    changed = [f | {"verification_status": "verified" if stands.get(f["tool_run_id"])
                    else "failed_verification"} for f in findings]
    ws.records.append("findings", changed)
    return {f["id"]: f["verification_status"] == "verified" for f in changed}
