"""Storage, tools and whole investigations."""

import base64
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

import scenarios
from inquest.operators import drivers
from inquest.plans.investigate import choose_columns, investigate, resume, timeline
from inquest.plans.tools import TOOLS, Workspace, call_tool, reverify
from inquest.sources import readers
from inquest.sources.records import evidence_table, upsert
from inquest.sources.versions import lineage, list_datasets, table_checksum


@pytest.fixture
def ws(spark, folder):
    return Workspace(spark, folder)


def test_readers_agree(spark, tmp_path):
    pdf = pd.DataFrame({"k": [1, 2], "name": ["a", None], "v": [1.5, None]})
    pdf.to_csv(tmp_path / "t.csv", index=False)
    pdf.to_csv(tmp_path / "t.tsv", sep="\t", index=False)
    (tmp_path / "t.json").write_text('[{"k": 1, "name": "a", "v": 1.5}, {"k": 2, "name": null, "v": null}]')
    spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "k long, name string, v double").write.parquet(str(tmp_path / "t.parquet"))
    rows = {s: sorted(tuple(r) for r in readers.read_table(spark, str(tmp_path / f"t.{s}")).select("k", "name", "v").collect())
            for s in ("csv", "tsv", "json", "parquet")}
    assert all(r == [(1, "a", 1.5), (2, None, None)] for r in rows.values())
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.exe")


def test_source_registration_and_dispatch(spark, tmp_path):
    (tmp_path / "note.md").write_text("hello")
    row = readers.register_files(spark, str(tmp_path / "note.md"), "me").first()
    assert (row["size_bytes"], row["kind"], row["source_format"]) == (5, "document", ".md")
    assert row["checksum"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    cases = [("https://a.com/x.pdf", "text/html; charset", ".pdf"), ("https://a.com/x.csv", "", ".csv"), ("https://a.com", None, ".html"),
             ("https://a.com/x", "text/plain", ".txt"), ("https://a.com/x.exe", None, ".html")]
    df = spark.createDataFrame(cases, "u string, c string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", readers.content_suffix(F.col("u"), F.col("c"))).collect())
    assert readers.jdbc_origin("jdbc:x://me:secret@host/db") == "host/db"
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "jdbc:x", "delete from t")


def test_versions_are_numbered_linked_and_never_overwritten(spark, ws):
    df = spark.createDataFrame(scenarios.regional_decline())
    one = ws.versions.write(df, "sales")
    two = ws.versions.write(df.where("region = 'South'"), "sales", "cleaned", one["version_id"])
    assert [one["version_number"], two["version_number"]] == [1, 2]
    assert ws.versions.resolve("sales")["version_id"] == two["version_id"]
    assert ws.versions.resolve("sales", one["version_id"])["row_count"] == df.count()
    part = ws.versions.scoped("sales", "2023-06-01", "2024-03-31", one["version_id"])
    again = ws.versions.scoped("sales", "2023-06-01", "2024-03-31", part["version_id"])
    assert part["version_type"] == "scoped" and again["version_id"] == part["version_id"]
    assert ws.versions.scoped("sales", "2000-01-01", None, one["version_id"])["version_id"] == one["version_id"]
    assert ws.versions.resolve("sales")["version_id"] == two["version_id"]
    steps = lineage(ws.versions.manifest(), part["version_id"])
    assert [r["version_type"] for r in steps.orderBy("steps").collect()] == ["scoped", "raw"]
    assert list_datasets(ws.versions.manifest()).first()["versions"] == 3
    assert ws.versions.preview("sales", rows=3).count() == 3
    with pytest.raises(ValueError):
        ws.versions.write(df, "sales", "other")


def test_lineage_ends_on_a_cycle(spark):
    rows = [("a", "b", "scoped", 1), ("b", "a", "scoped", 2)]
    m = spark.createDataFrame(rows, "version_id string, parent_version_id string, version_type string, version_number int")
    assert lineage(m, "a").count() == 2


def test_checksum_ignores_order_but_not_copies(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "i int, s string")
    mark = table_checksum(df).first()[0]
    assert table_checksum(df.repartition(7).select("s", "i")).first()[0] == mark
    assert table_checksum(df.unionByName(df.limit(1))).first()[0] != mark


def test_records_update_delete_and_guards(ws):
    inv = ws.records.append("investigations", [{"question": "q", "dataset_id": "d", "status": "running", "round": 1}])[0]["id"]
    with pytest.raises(ValueError):
        ws.records.save_finding(investigation_id=inv, statement="s", finding_type="guess")
    f = ws.records.save_finding(investigation_id=inv, statement="region = 'S' contributed 9%", finding_type="driver")
    with pytest.raises(ValueError):
        ws.records.save_recommendation(investigation_id=inv, finding_id=f["id"], action="a")
    ws.records.update("findings", f["id"], verification_status="verified")
    r = ws.records.save_recommendation(investigation_id=inv, finding_id=f["id"], action="a")
    ws.records.record_feedback(r["id"], "useful", "good")
    with pytest.raises(ValueError):
        ws.records.record_feedback(r["id"], "maybe")
    assert ws.records.read("recommendations").first()["user_decision"] == "accepted"
    past = drivers.past_feedback(ws.records.read("feedback"), ws.records.read("recommendations"),
                                 ws.records.read("findings"), ["Region = 'X' fell", "other = 1"]).collect()
    assert [(p["driver_key"], p["matched"], p["useful"]) for p in past] == [("region", 1, 1)]
    assert [ws.records.save_report(investigation_id=inv, title="t")["version_number"] for _ in range(2)] == [1, 2]
    with pytest.raises(ValueError):
        ws.records.request_evidence(investigation_id=inv, request_type="money", question="?")
    assert evidence_table(ws.records.read("findings"), ws.records.read("tool_runs")).count() == 1
    ws.records.append("sources", [{"id": "s1", "name": "n", "is_deleted": False}])
    ws.records.append("datasets", [{"name": "n", "source_id": "s1"}])
    with pytest.raises(ValueError):
        ws.records.delete("sources", "s1")
    ws.records.delete("investigations", inv)
    assert all(ws.records.read(t).count() == 0 for t in ("investigations", "findings", "recommendations", "reports", "feedback"))


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("u1", None, 1), ("u2", "me", 2)], "url string, owner string, v int")
    new = spark.createDataFrame([("u1", None, 9)], old.schema)
    assert sorted((r["url"], r["v"]) for r in upsert(old, new, ["url", "owner"]).collect()) == [("u1", 9), ("u2", 2)]


def test_all_tools_are_named_and_errors_are_logged(ws, spark):
    assert len(TOOLS) == 22
    ws.versions.write(spark.createDataFrame(scenarios.regional_decline()), "sales")
    result, run = call_tool(ws, "run_dataframe_code", {"dataset_id": "sales", "operation": "exec"})
    assert run["status"] == "error" and "error" in result and not reverify(ws, run)["verified"]
    for name, params in (("inspect_dataset", {}), ("run_readonly_sql", {"query": "select region, count(*) n from data group by 1"}),
                         ("render_chart", {"spec": {"type": "hist", "column": "revenue"}}),
                         ("render_chart", {"spec": {"type": "line", "x": "date", "y": "revenue"}}),
                         ("run_statistical_test", {"test": "chi_square", "params": {"column_a": "region", "column_b": "product"}}),
                         ("run_dataframe_code", {"operation": "correlation"})):
        result, run = call_tool(ws, name, {"dataset_id": "sales"} | params)
        assert run["status"] == "success", result
        assert reverify(ws, run)["verified"]
    with pytest.raises(ValueError):
        call_tool(ws, "rm", {})


def test_upload_clean_and_drift(ws):
    csv = scenarios.dirty().to_csv(index=False).encode()
    up, run = call_tool(ws, "ingest_source", {"filename": "d.csv", "content_base64": base64.b64encode(csv).decode()})
    assert run["status"] == "success", up
    done, run = call_tool(ws, "apply_cleaning_plan", {"dataset_id": up["dataset_id"]})
    assert run["status"] == "success", done
    assert done["version_number"] == 2 and done["health_after"] >= done["health_before"]
    report, run = call_tool(ws, "detect_drift", {"dataset_id": up["dataset_id"]})
    assert run["status"] == "success" and (report["from_version"], report["to_version"]) == (1, 2)


def test_documents_and_pages_become_searchable(ws, spark, tmp_path):
    up, _ = call_tool(ws, "ingest_source", {"filename": "n.txt", "content_base64": base64.b64encode(
        b"Churn is the share of customers who leave").decode()})
    doc, run = call_tool(ws, "extract_document", {"source_id": up["source_id"], "document_type": "kpi_definition"})
    assert doc["chunks"] == 1
    assert "share of customers" in call_tool(ws, "get_business_definition", {"term": "churn is the share"})[0]["definition"]
    body = "<title>T</title><p>" + "warehouse news today " * 12 + "</p>"
    stored = str(tmp_path / "pages.parquet")
    spark.createDataFrame([("https://a.com", body)], "url string, html string").write.parquet(stored)
    for _ in range(2):  # the second walk replaces the first
        walk, run = call_tool(ws, "fetch_url", {"url": "https://a.com", "pages_path": stored})
        assert run["status"] == "success" and walk["row_count"] == 1, walk
    hits, _ = call_tool(ws, "vector_search", {"query": "warehouse news", "document_type": "web_page"})
    assert hits["row_count"] == 1


def test_investigation_finds_verifies_and_remembers(ws, spark):
    ws.versions.write(spark.createDataFrame(scenarios.moved_driver()), "sales")
    first = investigate(ws, "Why did revenue decline?", "sales", "2022-01-01", "2023-05-31")
    lead = first["findings"][0]
    assert lead["statement"].startswith("region = 'A' contributed") and lead["verification_status"] == "verified"
    assert all(first["verified"].values()) and first["recommendations"][0]["rank"] == 1
    second = investigate(ws, "Why did revenue decline?", "sales", "2023-07-01", "2024-12-31")
    assert second["findings"][0]["statement"].startswith("product = 'Y' contributed")
    assert second["comparison"]["comparisons"][0]["driver_change"] == "replaced"
    assert {r["what"] for r in timeline(ws, second["investigation_id"]).collect()} >= {"profile_columns", "run_forecast"}
    content = json.loads(second["report"]["content"])
    assert content["findings"] and content["hypotheses"]


def test_asks_instead_of_guessing_then_resumes_with_data(ws, spark):
    pdf = scenarios.no_explanation()
    ws.versions.write(spark.createDataFrame(pdf), "orders")
    out = investigate(ws, "Why did revenue drop?", "orders", stages=("evidence_gap", "verification"))
    assert out["status"] == "awaiting_user"
    assert {f["finding_type"] for f in out["findings"]} == {"measurement"}
    request = ws.records.read("requests").where("request_type = 'missing_dataset'").first()
    months = pdf["date"].drop_duplicates()
    extra = spark.createDataFrame(pd.DataFrame({"date": months, "stock": [95.0 if m < pd.Timestamp("2024-06-01") else 40.0 + i % 3
                                                                     for i, m in enumerate(months)]}))
    more = resume(ws, out["investigation_id"], request["id"], "here is the stock", extra)
    assert any(f["finding_type"] == "association" and "stock" in f["statement"] for f in more["findings"])
    assert ws.versions.resolve("orders")["version_type"] == "enriched"


def test_refined_pair_leads(ws, spark):
    ws.versions.write(spark.createDataFrame(scenarios.pair_decline()), "sales")
    out = investigate(ws, "Why did revenue decline?", "sales", stages=("verification",))
    assert out["findings"][0]["statement"].startswith("Within ") and "Widget" in out["findings"][0]["statement"]


def test_investigation_names_one_store_of_many_and_its_pair(ws, spark):
    days = F.explode(F.expr("sequence(date'2023-01-01', date'2024-12-01', interval 1 month)"))
    sales = spark.range(1500).select(F.concat(F.lit("store "), "id").alias("store"), F.pmod("id", F.lit(5)).alias("k"),
                                     days.alias("date"))
    sales = sales.select("date", "store", F.concat(F.lit("area "), "k").alias("area"),
                         F.explode(F.array(*map(F.lit, ("web", "shop", "phone")))).alias("channel"))
    fell = (F.col("store") == "store 42") & (F.col("channel") == "shop") & (F.col("date") >= "2024-07-01")
    held = F.when(F.col("store") == "store 42", 40000.0).otherwise(100.0) + F.pmod(F.xxhash64("store", "date"), F.lit(9))
    ws.versions.write(sales.withColumn("revenue", F.when(fell, held * 0.1).otherwise(held)), "sales")
    out = investigate(ws, "Why did revenue decline?", "sales", stages=("verification",))
    said = [f["statement"] for f in out["findings"]]
    assert any(s.startswith("store = 'store 42' contributed") for s in said), said
    assert any(s.startswith("Within ") and "shop" in s and "store 42" in s for s in said), said


def test_column_choice(spark):
    rows = [(0, "date", "datetime", "date", 9), (1, "units", "numeric", None, 99), (2, "revenue", "numeric", "measure", 99),
            (3, "channel", "categorical", None, 2), (4, "region", "categorical", "geography", 4), (5, "city", "categorical", "geography", 90)]
    cols = spark.createDataFrame(rows, "position int, `column` string, inferred_type string, semantic_label string, unique_count long")
    plan = choose_columns("why did units fall?", cols, most_values=50, dimensions=3)
    assert (plan["metric"], plan["date"], plan["dimensions"]) == ("units", "date", ["region", "channel"])
    assert choose_columns("why?", cols)["dimensions"] == ["region", "city", "channel"]
    assert choose_columns("why?", cols)["metric"] == "revenue"
