"""Profiling, cleaning, drift, joins, redaction and scoring."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import scenarios
from inquest.operators import (cleaning, drift, duplicates, evaluation, joining, profiling, redaction)

NOW = dt.datetime(2025, 6, 1)


def issues(spark, pdf, **kw):
    return profiling.profile(spark.createDataFrame(pdf), NOW, **kw)


def test_types_and_labels(spark):
    n = 100
    rng = np.random.default_rng(0)
    p = issues(spark, pd.DataFrame({
        "order_id": [f"O{i:04d}" for i in range(n)],
        "order_date": pd.date_range("2024-01-01", periods=n).strftime("%Y-%m-%d"),
        "region": rng.choice(["N", "S"], n), "revenue": rng.normal(100, 5, n),
        "active": rng.random(n) < 0.5, "comment": ["long text " * 8 + str(i) for i in range(n)]}))
    got = {c["column"]: (c["inferred_type"], c["semantic_label"]) for c in p.columns}
    assert got == {"order_id": ("id", "identifier"), "order_date": ("datetime", "date"),
                   "region": ("categorical", "geography"), "revenue": ("numeric", "measure"),
                   "active": ("boolean", None), "comment": ("text", None)}


def test_missing_negative_duplicate(spark):
    p = issues(spark, pd.DataFrame({"revenue": [100.0, -20.0, np.nan, 100.0] * 5}))
    assert {("revenue", "missing_values"), ("revenue", "invalid_range"), ("__dataset__", "duplicate_rows")} <= p.pairs()


def test_nan_and_null_are_the_same_gap(spark):
    from inquest.functions.tables import nan_to_null
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double"))
    assert df.where("v IS NULL").count() == 2


def test_dates_zones_order_units_and_labels(spark):
    p = issues(spark, pd.DataFrame({"order_date": ["2024-01-01", "2024-01-02", "not-a-date", "2024-01-04"] * 10}))
    assert p.columns[0]["inferred_type"] == "datetime" and ("order_date", "date_problems") in p.pairs()
    p = issues(spark, pd.DataFrame({"event_time": ["2024-01-01T10:00:00+05:00", "2024-01-02T10:00:00Z",
                                                   "2024-01-03T10:00:00"] * 8}))
    assert ("event_time", "timezone_inconsistency") in p.pairs() and ("event_time", "date_problems") not in p.pairs()
    order = pd.DataFrame({"n": range(24), "date": pd.to_datetime(["2024-03-01", "2024-01-01", "2024-02-01"] * 8)})
    assert ("date", "date_ordering") in issues(spark, order, order_by="n").pairs()
    calm = order.assign(date=order["date"].sort_values().to_numpy())
    assert ("date", "date_ordering") not in issues(spark, calm, order_by="n").pairs()
    p = issues(spark, pd.DataFrame({"weight": ["5kg", "11 lb", "7kg", "3 lb"] * 5}))
    assert ("weight", "inconsistent_units") in p.pairs()
    assert ("region", "similar_categories") in issues(spark, pd.DataFrame({"region": ["north", "norht", "south"] * 8})).pairs()
    assert ("region", "similar_categories") not in issues(
        spark, pd.DataFrame({"region": ["north", "south", "east", "west"] * 8})).pairs()


def test_order_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(profiling, "ORDER_BLOCK", 4)
    days = [1, 2, 3, 9, 4, 5, 6, 7, 8, 3]
    pdf = pd.DataFrame({"n": range(10), "d": pd.to_datetime("2024-01-01") + pd.to_timedelta(days, "D")})
    steps = profiling.backward_steps(profiling.ordered_by(spark.createDataFrame(pdf), "n"), ["d"]).first()["steps"]
    assert steps == 2


def test_file_order(spark, folder):
    pdf = pd.DataFrame({"d": pd.to_datetime(["2024-03-01", "2024-01-01", "2024-02-01"])})
    spark.createDataFrame(pdf).coalesce(1).write.parquet(folder)
    stored = profiling.stored_order(spark.read.parquet(folder))
    assert profiling.backward_steps(stored, ["d"]).first()["steps"] == 1
    assert profiling.stored_order(spark.createDataFrame(pdf)) is None


def test_keys_and_secrets(spark):
    pdf = pd.DataFrame({"account_no": ["A1", "A1", "A2", "A3"], "v": [1, 2, 3, 4]})
    p = issues(spark, pdf, sensitive=["account_no"])
    assert ("account_no", "duplicate_keys") in p.pairs() and ("__dataset__", "duplicate_rows") not in p.pairs()
    assert p.columns[0]["top_values"] is None and "A1" not in str(p.issues)
    assert p.columns_df(spark).count() == 2


def test_dirty_table_end_to_end(spark):
    df = spark.createDataFrame(scenarios.dirty()).withColumn(
        "revenue", F.when(~F.isnan("revenue"), F.col("revenue")))
    before = profiling.profile(df, NOW)
    truth = spark.createDataFrame(scenarios.EXPECTED_ISSUES, "`column` string, issue string")
    found = spark.createDataFrame(list(before.pairs()), "`column` string, issue string")
    score = evaluation.quality_detection(truth, found).first()
    assert (score["recall"], score["precision"]) == (1.0, 1.0)
    plan = cleaning.propose_plan(df)
    clean, log = cleaning.apply_plan(df, plan, [o.op_id for o in plan.operations])
    after = profiling.profile(clean, NOW)
    remaining = spark.createDataFrame(list(after.pairs()), "`column` string, issue string")
    by_design = spark.createDataFrame(scenarios.BY_DESIGN, "`column` string, issue string")
    r = evaluation.cleaning_correctness(truth, by_design, remaining, df.count(), clean.count(), 240, 10).first()
    assert (r["defects_resolved"], r["defects_repairable"], r["rows_after"], r["correct"]) == (5, 5, 240, True)
    assert after.health > before.health
    affected = {o.operation: o.affected for o in log.operations}
    assert affected["drop_exact_duplicates"] == 10 and affected["null_out_negative_values"] == 6


def test_nothing_destructive_without_approval(spark):
    pdf = pd.DataFrame({"revenue": [100.0, -50.0, None, 100.0] * 5, "region": [" north", "North ", "SOUTH", "south"] * 5,
                        "k": range(20)})
    df = spark.createDataFrame(pdf).withColumn("revenue", F.when(~F.isnan("revenue"), F.col("revenue")))
    clean, log = cleaning.apply_plan(df, cleaning.propose_plan(df))
    assert {o.operation for o in log.operations if o.executed} == {"strip_whitespace", "normalize_category_casing"}
    assert clean.where("revenue < 0").count() == 5 and clean.where("revenue IS NULL").count() == 5
    assert {r["region"] for r in clean.select("region").distinct().collect()} == {"North", "South"}
    assert df.where("region = ' north'").count() == 5


def test_imputation(spark):
    df = spark.createDataFrame([(1, "b", None), (2, None, "x"), (None, "a", "x"), (7, "a", "x"), (4, "b", "x")],
                               "n int, c string, k string")
    plan = cleaning.Plan([cleaning.Operation("impute_missing_median", "n", "", 1),
                          cleaning.Operation("impute_missing_mode", "c", "", 1),
                          cleaning.Operation("impute_missing_mode", "nowhere", "", 1)])
    clean, log = cleaning.apply_plan(df, plan, [o.op_id for o in plan.operations])
    assert clean.where("k IS NOT NULL AND n = 3").count() == 1
    assert clean.where("n = 2").first()["c"] == "a"
    assert [o.executed for o in log.operations] == [True, True, False]


def test_drift(spark):
    rng = np.random.default_rng(0)
    a, b = (spark.createDataFrame(pd.DataFrame({"revenue": rng.normal(m, 10, 500)})) for m in (100, 160))
    assert drift.detect_drift(a, b).first()["severity"] == "high"
    same = drift.detect_drift(a, a)
    assert same.first()["psi"] == 0 and drift.verdict(same).first()["drifted_columns"] == []
    old = spark.createDataFrame([("North", 1.0)] * 20, "region string, revenue double")
    new = spark.createDataFrame([("Mars", 1)] * 20, "region string, orders int")
    changes = {r["column"]: r["change"] for r in drift.schema_changes(old, new).collect()}
    assert changes == {"region": "same", "orders": "added", "revenue": "removed"}
    row = drift.detect_drift(old, new).first()
    assert row["new_labels"] == ["Mars"] and row["missing_labels"] == ["North"] and row["severity"] == "high"


def keyed(spark, values):
    return spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "k string, v double")


def test_join_checks(spark):
    def check(a, b):
        return joining.validate_join(keyed(spark, a), keyed(spark, b), "k").first()
    assert check(["a", "a", "b"], ["a", "a", "b"])["cardinality"] == "many-to-many"
    ok = check(["a", "a", "b"], ["a", "b"])
    assert ok["cardinality"] == "many-to-one" and ok["safe"]
    assert check(["a"], ["z"])["matched_keys"] == 0 and not check(["a"], ["z"])["safe"]
    assert any("missing" in p for p in check(["a", None], ["a"])["problems"])


def test_enrichment(spark):
    base = spark.createDataFrame(scenarios.regional_decline())
    dates = base.select("date").distinct().withColumn("price", F.dayofyear("date").cast("double"))
    assert joining.suggest_join_key(base, dates) == "date"
    for limit in (10 ** 6, 0):
        merged = joining.enrich(base, dates, "date", broadcast_rows=limit)
        assert merged.count() == base.count() and merged.columns == [*base.columns, "price"]
    with pytest.raises(ValueError, match="adds no column"):
        joining.enrich(base, dates.select("date"), "date")
    with pytest.raises(ValueError, match="No usable join key"):
        joining.enrich(base, spark.createDataFrame([(1,)], "other int"))


def test_scrubbing(spark):
    def scrub(text, values):
        return spark.createDataFrame([(text,)], "t string").select(redaction.scrub(F.col("t"), values)).first()[0]
    assert scrub("call ANN MARIE and ann", ["Ann", "Ann Marie"]) == "call [REDACTED] and [REDACTED]"
    assert scrub("1 NA longvalue", ["1", "NA", "LONGVALUE"]) == "1 NA [REDACTED]"
    assert scrub("a.b a+b axb (c)", ["a.b", "a+b", "(c)"]) == "[REDACTED] [REDACTED] axb [REDACTED]"
    assert scrub("x", []) == "x"


def test_scrubbing_equals_a_plain_search(spark):
    import re
    rng = np.random.default_rng(3)
    values = ["".join(rng.choice(list("ab.*"), rng.integers(3, 7))) for _ in range(200)]
    text = "".join(rng.choice(list("AbB.* "), 3000))
    plain = re.compile("|".join(re.escape(v) for v in sorted(values, key=len, reverse=True)), re.I)
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(redaction.scrub(F.col("t"), values)).first()[0] == plain.sub("[REDACTED]", text)


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_scrubbing_a_column_equals_a_plain_search(spark, monkeypatch, part):
    import re
    monkeypatch.setattr(redaction, "PART_VALUES", part)
    rng = np.random.default_rng(5)
    letters = list("abKsSß.*🤖İı漢 ")
    values = ["".join(rng.choice(letters, rng.integers(3, 7))) for _ in range(150)] + ["Ann", "Ann Marie"]
    texts = ["".join(rng.choice([*letters, "A", "B", "k", "ſ", "\u212a"], 400)) for _ in range(30)]
    texts += ["İİİ call ANN MARIE now", "ann annmarie", "", None, "an"]
    usable = sorted({v for v in values}, key=len, reverse=True)
    plain = re.compile("|".join(re.escape(v) for v in usable), re.I)
    df = spark.createDataFrame(list(enumerate(texts)), "at int, `a text` string").repartition(3)
    secrets = spark.createDataFrame([("c", v) for v in values] + [("c", None), ("c", "x")],
                                    "`column` string, value string")
    got = redaction.scrub_column(df, "a text", secrets)
    assert got.columns == df.columns
    want = {i: t if t is None else plain.sub("[REDACTED]", t) for i, t in enumerate(texts)}
    assert {r[0]: r[1] for r in got.collect()} == want
    assert want[30] == "İİİ call [REDACTED] now"
    none = redaction.scrub_column(df, "a text", secrets.limit(0))
    assert none.collect() == df.collect()


def test_scrubbing_by_a_million_values(spark):
    values = spark.range(1_000_000).selectExpr("'c' AS `column`", "concat('Person-', id, '@x') AS value")
    df = spark.createDataFrame([(1, "to PERSON-77@x and Person-1000000@x"), (2, "person-999999@X.")],
                               "k int, t string")
    got = {r.k: r.t for r in redaction.scrub_column(df, "t", values).collect()}
    assert got == {1: "to [REDACTED] and Person-1000000@x", 2: "[REDACTED]."}


def test_matching_blocks_ratio():
    import difflib
    from inquest.functions.strings import matched
    rng = np.random.default_rng(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice(list("abcd\U0001f916"), rng.integers(1, 14))) for _ in "ab")
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert matched(a, b) == sum(x.size for x in m.get_matching_blocks()), (a, b)
    assert matched("", "abc") == 0


def test_similar_labels_of_a_wide_column(spark):
    import difflib
    rng = np.random.default_rng(4)
    labels = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 11))) for _ in range(4600)]
    for s in labels[:400]:                                   # typing slips
        k = int(rng.integers(0, len(s)))
        labels.append(s[:k] + s[k + 1:] if rng.random() < 0.5 else s[:k] + "x" + s[k:])
    labels = sorted(set(labels))
    counts = np.array([[s.count(c) for c in "abcdefghijx"] for s in labels], dtype=np.int16)
    size, want = counts.sum(1), {}
    for i in range(len(labels)):
        common = np.minimum(counts[i], counts[i + 1:]).sum(1)
        both = size[i] + size[i + 1:]
        for j in np.nonzero((5 * common >= 2 * both) & (np.abs(size[i] - size[i + 1:]) <= 3)
                            & (np.minimum(size[i], size[i + 1:]) >= 4))[0] + i + 1:
            ratio = difflib.SequenceMatcher(None, labels[i], labels[j], autojunk=False).ratio()
            if ratio >= 0.8:
                want[labels[i], labels[j]] = ratio
    df = spark.createDataFrame([(s, "one") for s in labels] + [(None, None)], "c string, d string")
    got = {(r.label, r.other): r.ratio for r in profiling.similar_labels(df, ["c", "d"]).collect()}
    assert got == want and len(want) > 500


def test_similar_long_labels_meet_in_pieces(spark, monkeypatch):
    import difflib
    monkeypatch.setattr(profiling, "PIECE", 7)
    rng = np.random.default_rng(8)
    syllables = ["an", "the", "ti", "on", "ere", "ble"]
    labels = {"".join(rng.choice(syllables, rng.integers(4, 8))) for _ in range(220)}
    labels |= {s[:k] + s[k + 1:] for s in sorted(labels) if (k := int(rng.integers(0, len(s)))) % 3 == 0}
    labels |= {"ananananananan", "anananananananan"}             # neighbours that a label repeats
    labels, want = sorted(x for x in labels if len(x) >= 4), {}
    for i, a in enumerate(labels):
        for b in labels[i + 1:]:
            if abs(len(a) - len(b)) <= 3:
                ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
                if ratio >= 0.8:
                    want[a, b] = ratio
    found = profiling.similar_labels(spark.createDataFrame([(s,) for s in labels], "c string"), ["c"])
    assert {(r.label, r.other): r.ratio for r in found.collect()} == want and len(want) > 150
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1                    # on distinct pairs, behind the last shuffle


def test_duplicates_by_hashes_first(spark):
    rows = [(None, 1.0, "a"), (None, 1.0, "a"), ("a", None, None), (None, None, "a"), ("x", -0.0, "b"),
                               ("x", 0.0, "b"), ("y", float("nan"), "c"), ("y", float("nan"), "c"), ("z", 2.0, "d")]
    df = spark.createDataFrame(rows, "h1_ string, v double, copies string").repartition(3)
    assert duplicates.duplicate_count(df).first()[0] == 3
    found = {(r["h1_"], r["copies"], r["copies_"]) for r in duplicates.repeated_rows(df).collect()}
    assert found == {(None, "a", 2), ("x", "b", 2), ("y", "c", 2)}
    once = duplicates.without_duplicates(df)
    assert once.columns == df.columns and once.count() == 6
    whole = spark.range(50).select("id", F.lit(None).cast("string").alias("n"))
    assert duplicates.without_duplicates(whole).count() == 50 and duplicates.duplicate_count(whole.limit(0)).first()[0] == 0


def test_touched_rows_are_counted_before_copies_go(spark):
    df = spark.createDataFrame([(i % 5, " A " if i % 2 else "a", 1.0 * (i % 5)) for i in range(40)], "k int, s string, v double")
    out, log = cleaning.apply_plan(df, cleaning.propose_plan(df))
    made = {o.operation: o.affected for o in log.operations if o.executed}
    assert made["strip_whitespace"] == 40 and made["drop_exact_duplicates"] == 35 and out.count() == 5


def test_guarded_sql_reads_only_its_view(spark, tmp_path):
    from inquest.operators.filters import readonly_sql
    path = str(tmp_path / "other")
    spark.range(3).write.parquet(path)
    spark.range(4).createOrReplaceTempView("elsewhere")
    spark.sql(f"CREATE TABLE kept_aside USING parquet LOCATION '{path}'")
    spark.createDataFrame([(7,)], "id long").createOrReplaceTempView("small")
    stored = spark.read.parquet(path).union(spark.range(5).toDF("id"))
    for data in (stored, spark.createDataFrame([(1, "please drop it"), (2, "x")], "id long, t string")):
        n = data.count()
        assert readonly_sql(data, "select count(*) n from data").first().n == n
        assert readonly_sql(data, "with a as (select id from data) select a.id from a join data b on a.id = b.id"
                                  " where a.id in (select max(id) from data)").count() >= 1
        assert readonly_sql(data, "select 'delete from drop ' as t, id from data").count() == n
        assert readonly_sql(data, "select * from values (1) v").count() == 1
        for bad in ("select * from small", "select * from data where id = (select max(id) from small)", "select * from elsewhere", "select * from kept_aside", "select id from data union all select id from elsewhere",
                    "select * from data where id in (select id from elsewhere)", "select (select max(id) from kept_aside) from data",
                    "select * from range(9)"):
            with pytest.raises(ValueError, match="only read"):
                readonly_sql(data, bad)
    with pytest.raises(ValueError, match="only read"):
        readonly_sql(spark.range(2).toDF("id"), f"select * from parquet.`{path}`")
    with pytest.raises(ValueError, match="Forbidden"):
        readonly_sql(stored, "select 1; drop table kept_aside")
    spark.sql("DROP TABLE kept_aside")


def test_scores(spark):
    def pairs(x):
        return spark.createDataFrame(x, "`column` string, issue string")
    r = evaluation.quality_detection(
        pairs([("a", "outliers"), ("b", "missing_values"), ("c", "date_problems")]),
        pairs([("a", "extreme_outliers"), ("b", "missing_values"), ("d", "constant_column"), ("e", "outliers")])).first()
    assert r["recall"] == pytest.approx(0.667) and r["missed"] == ["c/date_problems"] and r["spurious"] == ["e/outliers"]
    none = pairs([]) if False else spark.createDataFrame([], "`column` string, issue string")
    over = evaluation.cleaning_correctness(pairs([("a", "outliers")]), none, none, 110, 5, 100).first()
    assert over["rows_over_cleaned"] == 95 and not over["correct"]
    runs = spark.createDataFrame([
        ("1", '{"test": "ttest", "params": {"value_column": "v", "group_column": "g"}}'),
        ("2", '{"test": "ttest", "params": {"value_column": "g", "group_column": "g"}}'),
        ("3", '{"test": "unknown", "params": {}}')], "id string, parameters string")
    types = spark.createDataFrame([("v", "numeric"), ("g", "categorical")], "`column` string, inferred_type string")
    got = {r["id"]: r["appropriate"] for r in evaluation.test_appropriateness(runs, types).collect()}
    assert got == {"1": True, "2": False, "3": False}
    truth = spark.createDataFrame([("r1", "region", "South", "the South fell"), ("r2", "region", "South", "[error: South")],
                                  "run_id string, true_column string, true_value string, answer string")
    found = spark.createDataFrame([("r1", 1, "driver", "region = 'South' contributed 94%", "x", "high")],
                                  "run_id string, rank int, finding_type string, statement string, evidence_summary string, confidence string")
    scored = {r["run_id"]: (r["rank_1"], r["found"]) for r in evaluation.root_cause(truth, found).collect()}
    assert scored == {"r1": (True, True), "r2": (False, False)}
    systems = spark.createDataFrame([("s", "a", True, True, True, 2.0), ("s", "b", False, True, True, None)],
                                    "system string, scenario string, rank_1 boolean, found boolean, completed boolean, mape double")
    roll = evaluation.system_rollup(systems).first()
    assert (roll["rank_1_rate"], roll["found_rate"], roll["avg_mape"]) == (0.5, 1.0, 2.0)


def test_pairs_of_labels_meet_only_where_they_can_be_similar(spark):
    draw = np.random.default_rng(3)
    labels = {"".join(draw.choice(list("abcdefghijklmnop"), 8)) for _ in range(3000)}
    labels |= {"kitchenware", "kitchenwares", "a rather long label of words", "a rather long lable of words"}
    df = spark.createDataFrame([("c", s, len(s)) for s in sorted(labels)], "`column` string, label string, size int")
    short, long = profiling._short_pairs(df).collect(), profiling._long_pairs(df).collect()
    # random labels share neighbours by the thousand, but not seven of eight characters
    assert len(short) < 100 and ("kitchenware", "kitchenwares") in {(r.label, r.other) for r in short}
    assert [(r.label, r.other) for r in long] == [("a rather long label of words", "a rather long lable of words")]


def test_copies_are_looked_for_once(spark, monkeypatch):
    rows = [(k // 2, None if k % 5 == 0 else float(k), None if k % 7 == 0 else "ab"[k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows * 2, "k int, total_price double, status string")
    plan = cleaning.propose_plan(df)
    clean, log = cleaning.apply_plan(df, plan, [o.op_id for o in plan.operations])
    assert "Join" not in clean._jdf.queryExecution().executedPlan().toString()
    assert clean.count() == 60 and clean.where("total_price IS NULL OR status IS NULL").count() == 0
    assert {o.operation: o.affected for o in log.operations}["drop_exact_duplicates"] == 60
