"""From a question about a table to verified findings, a forecast and a report."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, Row, functions as F

from inquest.operators import drivers, joining, retrieval, summaries
from inquest.operators.driversearch import driver_search
from inquest.plans.tools import (RETURNED_SQL_ROWS, Workspace, call_tool, generate_recommendations,
                                 index_report, verify_findings)

STAGES = ("rag", "evidence_gap", "critic", "verification", "forecast", "recommendations")


# --- the plan: small tables of one row per column ----------------------------

def rank_dimensions(columns: DataFrame, most_values: int | None = None) -> DataFrame:
    """Categories, known segments first, then the fewest values; ``most_values`` leaves out wider ones."""
    known = F.when(F.col("semantic_label").isin("geography", "product", "customer"), 0).otherwise(1)
    kept = columns.where(F.col("inferred_type") == "categorical")
    if most_values is not None:
        kept = kept.where(F.col("unique_count") <= most_values)
    return kept.orderBy(known, "unique_count", "position")


def choose_columns(question: str, columns: DataFrame, most_values: int | None = None,
                   dimensions: int | None = None) -> dict:
    """Metric, date column and dimensions for a question, from the profile table.

    Every category is a dimension unless the caller limits their values or number.
    """
    asked = F.contains(F.lit(question.lower()), F.lower("column"))
    metric = (columns.where(F.col("inferred_type") == "numeric").orderBy(
        F.when(asked, 0).when(F.col("semantic_label") == "measure", 1).otherwise(2), "position")
        .limit(1).collect())
    kinds = {k: [r["column"] for r in columns.where(F.col("inferred_type") == k)
                 .orderBy("position").collect()] for k in ("numeric", "datetime", "categorical")}
    ranked = [r["column"] for r in rank_dimensions(columns, most_values).collect()]
    return {"metric": metric[0]["column"] if metric else None,
            "date": kinds["datetime"][0] if kinds["datetime"] else None,
            "dimensions": ranked[:dimensions],
            "numeric": kinds["numeric"], "categorical": kinds["categorical"]}


def propose_hypotheses(plan: dict) -> list[dict]:
    """One per dimension, one for the first other number, one for the trend."""
    metric = plan["metric"]
    if metric is None:
        return []
    out = [{"statement": f"The change in {metric} is concentrated in values of {d}.",
            "columns": [d, metric], "proposed_test": "period_contribution"} for d in plan["dimensions"]]
    other = next((c for c in plan["numeric"] if c != metric), None)
    if other:
        out.append({"statement": f"{other} moves together with {metric}.",
                    "columns": [other, metric], "proposed_test": "correlation"})
    if plan["date"]:
        out.append({"statement": f"{metric} follows a trend over time.",
                    "columns": [plan["date"], metric], "proposed_test": "time_series"})
    return out


def top_up(existing: list[dict], plan: dict, available: list[str]) -> list[dict]:
    """More hypotheses, about columns none of the existing ones covers."""
    covered = {c for h in existing for c in h["columns"]}
    fresh = set(available) - covered
    said = {h["statement"] for h in existing}
    more = [h for h in propose_hypotheses(plan) if fresh & set(h["columns"])]
    return [h for h in more if h["statement"] not in said]


# --- testing hypotheses ------------------------------------------------------

def _explanation(result: dict, dimension: str, row: dict, test: dict | None) -> str:
    season = (result["seasonality"] or {}).get(dimension) or {}
    parts = [f"period_contribution of {row['dimension']}, split {result['split_date']} "
             f"({result['split_method']}), overall {row['total_change_pct']}%."]
    if test:
        parts.append(f"Welch t-test p={test['p_value']:.4g}, d={test['cohens_d']}.")
    if season.get("checked") and season.get("year_on_year_pct") is not None:
        parts.append(f"Against the same {season['months_compared']} calendar months a year earlier "
                     f"the change is {season['year_on_year_pct']}%.")
    if row.get("low") is not None:
        parts.append(f"95% interval of the share {row['low']}% to {row['high']}%.")
    return " ".join(parts)


def _test_dimensions(ws: Workspace, inv: str, dataset: dict, plan: dict, hyps: list[dict]) -> None:
    """All dimensions in one call; then a significance test and a refinement where they hold."""
    dims, metric = [h["columns"][0] for h in hyps], plan["metric"]
    result, run = call_tool(ws, "run_dataframe_code", dataset | {
        "operation": "period_contribution",
        "params": {"date_column": plan["date"], "metric": metric, "by": dims,
                   "top": max(2, RETURNED_SQL_ROWS // len(dims))}}, inv, "analysis")
    if run["status"] != "success" or not result["rows"]:
        for h in hyps:
            h |= {"status": "unresolved", "reasoning": result.get("error", "no groups")}
        return
    for h, dim in zip(hyps, dims):
        rows = [r for r in result["rows"] if r["dimension"] == dim]
        if not rows:
            h |= {"status": "unresolved", "reasoning": "no groups"}
            continue
        verdict = drivers.driver_tests(ws.spark.createDataFrame(
            [Row(**{k: r[k] for k in CONTRIBUTION_FIELDS}) for r in rows], CONTRIBUTION_SCHEMA)).first()
        share = verdict["contribution_to_total_change_pct"]
        h |= {"status": "supported" if verdict["supported"] else "rejected",
              "confidence": verdict["confidence"],
              "reasoning": verdict["reject_reason"] or f"{dim}='{verdict['group']}' accounts for {share}%"}
        if not verdict["supported"]:
            continue
        test = None
        if verdict["runner_up"] is not None:
            found, t_run = call_tool(ws, "run_statistical_test", dataset | {
                "test": "ttest", "params": {"value_column": metric, "group_column": dim,
                                            "groups": [verdict["group"], verdict["runner_up"]]}},
                inv, "analysis")
            test = found if t_run["status"] == "success" else None
        season = (result["seasonality"] or {}).get(dim) or {}
        sure = ("low" if season.get("checked") and not season.get("survives") else
                "high" if share > 50 and test and test["significant"] else "medium")
        lead = next(r for r in rows if r["group"] == verdict["group"])
        finding = ws.records.save_finding(
            investigation_id=inv, hypothesis_id=h["id"], tool_run_id=run["id"], finding_type="driver",
            statement=f"{dim} = '{verdict['group']}' contributed {share}% of the total {metric} "
                      f"{verdict['direction']} (from {verdict['previous_per_period']} to "
                      f"{verdict['current_per_period']} per period, {verdict['change_pct']}%).",
            evidence_summary=_explanation(result, dim, lead, test),
            magnitude=abs(verdict["change"]), unit=metric, confidence=sure,
            caveats="Shows where the change is concentrated, not why." + (
                "" if season.get("checked") else " Seasonality could not be ruled out."))
        _refine(ws, inv, dataset, plan, dim, result["split_date"], finding)


CONTRIBUTION_FIELDS = ("dimension", "group", "previous_per_period", "current_per_period", "change",
                       "change_pct", "contribution_to_total_change_pct", "direction",
                       "total_change_per_period", "total_change_pct", "groups")
CONTRIBUTION_SCHEMA = ("dimension string, `group` string, previous_per_period double, "
                       "current_per_period double, change double, change_pct double, "
                       "contribution_to_total_change_pct double, direction string, "
                       "total_change_per_period double, total_change_pct double, groups long")


def _refine(ws: Workspace, inv: str, dataset: dict, plan: dict, primary: str, split: str,
            parent: dict) -> None:
    """Narrow the first driver to a pair of columns, once per investigation.

    Of several other columns, the one is taken whose pair with the leading value the search over
    all pairs puts first.
    """
    others = [d for d in plan["dimensions"] if d != primary]
    if not others or plan.get("refined"):
        return
    if len(others) > 1:
        pairs = driver_search(ws.table(**dataset), plan["date"], plan["metric"], plan["dimensions"], split)
        named = pairs.where((F.col("level") == 2) & F.array_contains(F.split("dimensions", " × "), primary))
        best = named.orderBy(F.desc("lift"), "dimensions", "groups").limit(1).collect()
        if best:
            others = [d for d in best[0]["dimensions"].split(" × ") if d != primary]
    result, run = call_tool(ws, "run_dataframe_code", dataset | {
        "operation": "interaction_contribution",
        "params": {"date_column": plan["date"], "metric": plan["metric"],
                   "by": [primary, others[0]], "split": split}}, inv, "analysis")
    if run["status"] != "success" or not result["rows"] or not result["rows"][0]["worth_reporting"]:
        return
    plan["refined"] = True
    top = result["rows"][0]
    ws.records.save_finding(
        investigation_id=inv, hypothesis_id=parent["hypothesis_id"], tool_run_id=run["id"],
        finding_type="driver", unit=plan["metric"], magnitude=abs(top["change"]),
        confidence=parent["confidence"],
        statement=f"Within {primary} = '{top['leading_group']}', the {top['direction']} is "
                  f"concentrated in {others[0]} = '{top['group']}' "
                  f"({top['contribution_to_total_change_pct']}% of that group's movement).",
        evidence_summary=f"interaction_contribution({primary} then {others[0]}, split "
                         f"{top['split_date']}) across {top['values_examined']} values.",
        caveats="Narrows where the movement sits; it does not say why.")


def _test_sizes(ws: Workspace, inv: str, dataset: dict, plan: dict, hyps: list[dict]) -> None:
    for h in hyps:
        dim, metric = h["columns"]
        result, run = call_tool(ws, "run_dataframe_code", dataset | {
            "operation": "groupby_aggregate", "params": {"by": dim, "metric": metric}}, inv, "analysis")
        if run["status"] != "success" or not result["rows"]:
            h |= {"status": "unresolved", "reasoning": result.get("error", "no groups")}
            continue
        top = result["rows"][0]
        share = top.get("share_pct") or 0
        held = share >= 100 / result["row_count"] * drivers.CONCENTRATION
        h |= {"status": "supported" if held else "rejected",
              "confidence": round(min(share / 100, 0.9), 2) if held else 0.2,
              "reasoning": f"{top['group']} accounts for {share}% of total {metric}."}
        if held:
            ws.records.save_finding(
                investigation_id=inv, hypothesis_id=h["id"], tool_run_id=run["id"],
                finding_type="driver", magnitude=top["value"], unit=metric, confidence="medium",
                statement=f"{dim} = '{top['group']}' accounts for {share}% of total {metric}.",
                evidence_summary=f"groupby_aggregate({metric} by {dim}, sum).",
                caveats="Without dates this measures size, not change.")


def _test_association(ws: Workspace, inv: str, dataset: dict, h: dict) -> None:
    a, b = h["columns"]
    result, run = call_tool(ws, "run_statistical_test", dataset | {
        "test": "correlation", "params": {"column_a": a, "column_b": b}}, inv, "analysis")
    if run["status"] != "success":
        h |= {"status": "unresolved", "reasoning": result["error"]}
        return
    r = result["r"]
    held = result["significant"] and abs(r) > 0.3
    h |= {"status": "supported" if held else "rejected", "confidence": round(min(abs(r), 0.9), 2),
          "reasoning": f"r={r:.3f}, p={result['p_value']:.4g}"}
    if held:
        ws.records.save_finding(
            investigation_id=inv, hypothesis_id=h["id"], tool_run_id=run["id"],
            finding_type="association", magnitude=abs(r), unit="correlation coefficient",
            confidence="medium", statement=f"{a} and {b} are correlated (r={r:.3f}, n={result['n']}).",
            evidence_summary=f"Pearson correlation, r-squared={result['r_squared']:.3f}, "
                             f"p={result['p_value']:.4g}.",
            caveats="A correlation does not establish a cause.")


def _test_trend(ws: Workspace, inv: str, dataset: dict, plan: dict, h: dict) -> None:
    metric = plan["metric"]
    result, run = call_tool(ws, "run_dataframe_code", dataset | {
        "operation": "time_series", "params": {"date_column": plan["date"], "metric": metric}},
        inv, "analysis")
    if run["status"] != "success":
        h |= {"status": "unresolved", "reasoning": result["error"]}
        return
    # the recorded result is a page; the rule looks at the whole series
    series = summaries.time_series(ws.table(**dataset), plan["date"], metric)
    ends = drivers.trend_test(series).first()
    if ends is None:
        h |= {"status": "unresolved", "reasoning": "fewer than three periods"}
        return
    change, pct, held = ends["change"], ends["change_pct"], ends["supported"]
    h |= {"status": "supported" if held else "rejected", "confidence": 0.7 if held else 0.2,
          "reasoning": f"{metric} moved {pct:.1f}% from first to last period."}
    if held:
        ws.records.save_finding(
            investigation_id=inv, hypothesis_id=h["id"], tool_run_id=run["id"],
            finding_type="measurement", magnitude=abs(change), unit=metric, confidence="high",
            statement=f"{metric} changed by {pct:.1f}% across the observed period.",
            evidence_summary=f"Monthly series over {ends['points']} periods: "
                             f"{ends['first']:.2f} -> {ends['last']:.2f}.",
            caveats="Says what changed, not why.")


# --- the investigation -------------------------------------------------------

def investigate(ws: Workspace, question: str, dataset_id: str, start: str | None = None,
                end: str | None = None, version_id: str | None = None, owner: str | None = None,
                horizon: int = 3, stages: tuple = STAGES, investigation_id: str | None = None,
                now: str | None = None) -> dict:
    """Answer why a metric changed. The version's rows are read once and kept while needed."""
    version = ws.versions.scoped(dataset_id, start, end, version_id)
    ws.hold(version)
    try:
        with ws.records.batch():
            return _run(ws, question, dataset_id, version, owner, horizon, stages, investigation_id,
                        now or dt.datetime.now().replace(microsecond=0).isoformat())
    finally:
        ws.release()


def _run(ws, question, dataset_id, version, owner, horizon, stages, inv, now) -> dict:
    dataset = {"dataset_id": dataset_id, "version_id": version["version_id"]}
    df = ws.table(**dataset)
    existing = []
    if inv is None:
        inv = ws.records.append("investigations", [{
            "question": question, "dataset_id": dataset_id, "version_id": version["version_id"],
            "owner_id": owner, "status": "running", "round": 1}])[0]["id"]
    else:
        mine = F.col("investigation_id") == inv
        existing = [r.asDict() for r in ws.records.read("hypotheses").where(mine)
                    .drop("recorded_at").collect()]
        ws.records.update("investigations", inv, version_id=version["version_id"], status="running")
    profile, _ = call_tool(ws, "profile_columns", dataset | {"now": now}, inv, "profiler")
    columns = ws.spark.createDataFrame(
        [(c["position"], c["column"], c["inferred_type"], c["semantic_label"], c["unique_count"])
         for c in profile["columns"]],
        "position int, `column` string, inferred_type string, semantic_label string, unique_count long")
    chunks = ws.chunks() if "rag" in stages else None
    known, context = [], []
    if chunks is not None and not chunks.isEmpty():
        terms, passages = retrieval.plan_context(chunks, question, df.columns, owner)
        known = [r["term"] for r in terms.collect()]
        context = [r["title"] for r in passages.collect()]
    plan = choose_columns(question, columns)
    ws.records.update("investigations", inv, target_metric=plan["metric"])
    wanted = top_up(existing, plan, df.columns) if existing else propose_hypotheses(plan)
    stored = ws.records.append("hypotheses", [
        h | {"investigation_id": inv, "status": "proposed"} for h in wanted])
    retry = [h for h in existing if h["status"] in ("testable", "blocked_missing_evidence")]
    hyps = [dict(h) for h in stored + retry]
    requests = 0
    if hyps:
        checked = drivers.missing_columns(ws.spark.createDataFrame(
            [(h["id"], h["columns"]) for h in hyps], "id string, columns array<string>"), df.columns)
        states = {r["id"]: r for r in checked.collect()}
        for h in hyps:
            h["status"] = states[h["id"]]["status"]
            if h["status"] == "blocked_missing_evidence" and "evidence_gap" in stages:
                missing = states[h["id"]]["missing"]
                ws.records.request_evidence(
                    investigation_id=inv, hypothesis_id=h["id"],
                    request_type="missing_field" if missing else "clarification",
                    question=f"To test '{h['statement'][:150]}' these fields are needed: {missing}",
                    reason=f"missing columns: {missing}")
                requests += 1
    ready = [h for h in hyps if h["status"] == "testable"]
    segments = [h for h in ready if h["proposed_test"] == "period_contribution"]
    if segments and plan["date"]:
        _test_dimensions(ws, inv, dataset, plan, segments)
    elif segments:
        _test_sizes(ws, inv, dataset, plan, segments)
    for h in ready:
        if h["proposed_test"] == "correlation":
            _test_association(ws, inv, dataset, h)
        elif h["proposed_test"] == "time_series":
            _test_trend(ws, inv, dataset, plan, h)
    fields = ("id", "investigation_id", "statement", "columns", "proposed_test", "status",
              "confidence", "reasoning")
    ws.records.append("hypotheses", [{k: h.get(k) for k in fields} for h in hyps])
    mine = F.col("investigation_id") == inv
    comparison, history = None, []
    if "rag" in stages:
        comparison, _ = call_tool(ws, "compare_investigations", {"current_id": inv}, inv, "history")
        if chunks is not None and not chunks.isEmpty():
            history = [r["title"] for r in retrieval.related_history(chunks, question, inv, owner).collect()]
    if plan["metric"]:
        snaps = summaries.metric_snapshot(df, plan["metric"], plan["dimensions"])
        ws.records.append_frame("snapshots", snaps.select(
            F.uuid().alias("id"), F.lit(inv).alias("investigation_id"),
            F.lit(version["version_id"]).alias("version_id"), F.lit(plan["metric"]).alias("metric"),
            "dimension", "group", "value"))
    findings = ws.records.read("findings").where(mine)
    if "evidence_gap" in stages and not drivers.evidence_gaps(findings).isEmpty():
        asked = ws.records.read("requests").where(mine & (F.col("request_type") == "missing_dataset"))
        if asked.isEmpty():
            ws.records.request_evidence(
                investigation_id=inv, request_type="missing_dataset",
                question=f"The change in {plan['metric']} is measured, but no column explains it. "
                         "Can you supply a segment or an operational measure?",
                reason="without an explanatory column any cause would be a guess")
            requests += 1
    if "critic" in stages:
        soft = drivers.soften_correlations(findings).alias("s").join(
            findings.select("id", F.col("confidence").alias("was")).alias("f"), "id")
        changed = soft.where(F.col("confidence") != F.col("was")).drop("was", "recorded_at")
        ws.records.append("findings", [r.asDict() for r in changed.collect()])
    verified = verify_findings(ws, inv) if "verification" in stages else {}
    rows = ws.records.read("findings").where(mine)
    if "verification" in stages:
        rows = rows.where(F.col("verification_status") == "verified")
    ranked = [r.asDict() for r in drivers.rank_findings(rows).orderBy("rank").collect()]
    lead = next((f for f in ranked if f["finding_type"] == "driver"), None)
    chart = None
    if lead and plan["date"]:
        by = next((d for d in plan["dimensions"] if d.lower() in lead["statement"].lower()), None)
        if by:
            chart, _ = call_tool(ws, "render_chart", dataset | {
                "spec": {"type": "bar", "x": by, "y": plan["metric"]}}, inv, "reporting")
    forecast = None
    if "forecast" in stages and plan["date"] and ranked:
        result, run = call_tool(ws, "run_forecast", dataset | {
            "date_column": plan["date"], "metric": plan["metric"], "horizon": horizon}, inv, "forecasting")
        if run["status"] == "success" and result["rows"]:
            f = result["rows"][0]
            forecast = ws.records.append("forecasts", [{
                "investigation_id": inv, "finding_id": ranked[0]["id"], "target_metric": plan["metric"],
                **{k: f[k] for k in ("model_name", "reliability", "withheld_reason", "predictions",
                                     "mape", "naive_mape", "folds")}}])[0]
    recs = (generate_recommendations(ws, inv, "verification" in stages)["recommendations"]
            if "recommendations" in stages else [])
    report = assemble_report(ws, inv, ranked, recs, forecast, comparison, history, chart, known, context)
    status = "awaiting_user" if requests else "complete"
    ws.records.update("investigations", inv, status=status)
    return {"investigation_id": inv, "status": status, "plan": plan, "findings": ranked,
            "hypotheses": hyps, "forecast": forecast, "recommendations": recs, "report": report,
            "verified": verified, "comparison": comparison}


def assemble_report(ws: Workspace, inv: str, findings: list[dict], recs: list[dict], forecast, comparison,
                    history, chart, known, context) -> dict:
    """One nested document of everything, stored and made retrievable."""
    row = ws.records.read("investigations").where(F.col("id") == inv).first()
    hyps = ws.records.read("hypotheses").where(F.col("investigation_id") == inv).collect()
    content = {
        "question": row["question"], "target_metric": row["target_metric"], "findings": findings,
        "hypotheses": [{"statement": h["statement"], "status": h["status"], "reasoning": h["reasoning"]}
                       for h in hyps],
        "unresolved": [h["statement"] for h in hyps
                       if h["status"] in ("unresolved", "blocked_missing_evidence")],
        "forecast": forecast, "recommendations": recs, "actions": [r["action"] for r in recs],
        "comparison": comparison, "history": history, "chart": chart,
        "retrieval": {"definitions": known, "context": context}}
    summary = (" ".join(f["statement"] for f in findings[:5]) if findings
               else "No verified finding; no conclusion is offered.")
    report = ws.records.save_report(
        investigation_id=inv, title=f"Investigation report: {row['question'][:150]}",
        executive_summary=summary, content=json.dumps(content, default=str))
    index_report(ws, report["id"])
    return report


def resume(ws: Workspace, investigation_id: str, request_id: str, response: str,
           extra: DataFrame | None = None) -> dict:
    """Answer a request, with a supplementary table when there is one, and go on."""
    if not response.strip():
        raise ValueError("an empty response cannot be used")
    request = ws.records.read("requests").where(F.col("id") == request_id).first()
    if request is None or request["investigation_id"] != investigation_id:
        raise ValueError("No such request for this investigation")
    ws.records.update("requests", request_id, status="answered", response=response)
    inv = ws.records.read("investigations").where(F.col("id") == investigation_id).first()
    version = ws.versions.resolve(inv["dataset_id"], inv["version_id"])
    if extra is not None:
        base = ws.versions.load(version)
        merged = joining.enrich(base, extra)
        added = [c for c in merged.columns if c not in base.columns]
        version = ws.versions.write(merged, inv["dataset_id"], "enriched", version["version_id"],
                                    {"operation": "merge_supplementary", "added_columns": added}, "merge")
    named = [c for c in ws.versions.load(version).columns if c.lower() in response.lower()]
    if request["hypothesis_id"]:
        changes = ({"columns": named, "status": "testable"} if named else
                   {"status": "unresolved", "reasoning": "the requested evidence is not available"})
        ws.records.update("hypotheses", request["hypothesis_id"], **changes)
    ws.records.update("investigations", investigation_id, round=inv["round"] + 1)
    return investigate(ws, inv["question"], inv["dataset_id"], version_id=version["version_id"],
                       owner=inv["owner_id"], investigation_id=investigation_id)


def timeline(ws: Workspace, investigation_id: str) -> DataFrame:
    """Tool runs and hypotheses of an investigation in order."""
    mine = F.col("investigation_id") == investigation_id
    runs = ws.records.read("tool_runs").where(mine).select(
        "recorded_at", F.lit("tool_run").alias("kind"), F.col("tool_name").alias("what"), "status")
    hyps = ws.records.read("hypotheses").where(mine).select(
        "recorded_at", F.lit("hypothesis").alias("kind"), F.col("statement").alias("what"), "status")
    return runs.unionByName(hyps).orderBy("recorded_at", "kind", "what")
