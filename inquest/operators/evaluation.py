"""Scores of profiles, cleaning, forecasts and investigations against known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A detected issue may carry another name than the injected one (fixed values).
EQUIVALENT = {
    "outliers": ("outliers", "extreme_outliers"),
    "date_problems": ("date_problems", "implausible_dates", "timezone_inconsistency"),
}
OBSERVATIONS = ("constant_column", "date_ordering", "anomalous_rows")
REQUIREMENTS = {
    "ttest": {"value_column": "numeric", "group_column": "categorical"},
    "correlation": {"column_a": "numeric", "column_b": "numeric"},
    "chi_square": {"column_a": "categorical", "column_b": "categorical"},
    "linear_regression": {"y_column": "numeric"},
}
CAUSAL = ("driver", "association")


def with_aliases(expected: DataFrame) -> DataFrame:
    """``alias``: every name under which an expected issue may be reported."""
    chain = F.array("issue")
    for name, aliases in EQUIVALENT.items():
        chain = F.when(F.col("issue") == name, F.array(*[F.lit(a) for a in aliases])).otherwise(chain)
    return expected.withColumn("alias", F.explode(chain))


def matched_issues(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected (column, issue) pairs with ``hit``."""
    named = with_aliases(expected.select("column", "issue").distinct())
    seen = found.select("column", F.col("issue").alias("alias")).distinct().withColumn("seen", F.lit(True))
    return (named.join(seen, ["column", "alias"], "left").groupBy("column", "issue")
            .agg(F.bool_or(F.coalesce("seen", F.lit(False))).alias("hit")))


def quality_detection(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Recall, precision and F1 of issue detection, from (column, issue) pairs."""
    hits = matched_issues(expected, found)
    explained = with_aliases(expected).select("column", F.col("alias").alias("issue")).distinct()
    spurious = (found.select("column", "issue").distinct()
                .where(~F.col("issue").isin(*OBSERVATIONS)).join(explained, ["column", "issue"], "left_anti"))
    label = F.concat_ws("/", "column", "issue")
    wrong = spurious.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(label)).alias("s"))
    rows = hits.agg(F.count(F.lit(1)).alias("expected"), F.count_if("hit").alias("detected"),
                    F.sort_array(F.collect_list(F.when(~F.col("hit"), label))).alias("missed"))
    rows = rows.withColumn("n", wrong.select("n").scalar()).withColumn(
        "spurious", wrong.select("s").scalar())
    recall = F.col("detected") / F.col("expected")
    precision = F.col("detected") / F.greatest(F.col("detected") + F.col("n"), F.lit(1))
    both = recall + precision
    return rows.where("expected > 0").select(
        "expected", "detected", F.round(recall, 3).alias("recall"),
        F.round(precision, 3).alias("precision"),
        F.when(both > 0, F.round(2 * recall * precision / both, 3)).otherwise(0.0).alias("f1"),
        "missed", "spurious")


def cleaning_correctness(expected: DataFrame, by_design: DataFrame, remaining: DataFrame,
                         rows_before: int, rows_after: int, clean_rows: int | None = None,
                         injected_copies: int = 0) -> DataFrame:
    """Whether repairable defects are gone and no valid row went with them."""
    wanted = clean_rows or rows_before - injected_copies
    repairable = expected.join(by_design, ["column", "issue"], "left_anti")
    done = matched_issues(repairable, remaining).agg(
        F.count(F.lit(1)).alias("defects_repairable"), F.count_if(~F.col("hit")).alias("defects_resolved"))
    kept = min(rows_after / wanted, 1.0) if wanted else 0.0
    over, under = max(0, wanted - rows_after), max(0, rows_after - wanted)
    return done.select(
        "defects_repairable", "defects_resolved",
        F.when(F.col("defects_repairable") > 0, F.round(
            F.col("defects_resolved") / F.col("defects_repairable"), 3)).alias("resolution_rate"),
        F.lit(rows_before).alias("rows_before"), F.lit(rows_after).alias("rows_after"),
        F.lit(round(kept, 3)).alias("retention"), F.lit(over).alias("rows_over_cleaned"),
        F.lit(under).alias("rows_under_cleaned"),
        ((F.col("defects_resolved") == F.col("defects_repairable")) & F.lit(over == 0)).alias("correct"))


def numerical_accuracy(pairs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``expected`` against ``reported`` magnitudes."""
    error = F.when(F.col("expected") != 0, F.abs(F.col("reported") - F.col("expected"))
                   / F.abs("expected")).otherwise(F.lit(float("inf")))
    return pairs.withColumn("relative_error", F.round(error, 4)).withColumn(
        "correct", F.coalesce(error <= tolerance, F.lit(False)))


def hypothesis_rates(hypotheses: DataFrame) -> DataFrame:
    """Testable and settled shares per investigation."""
    def share(*states: str) -> Column:
        return F.round(F.avg(F.col("status").isin(*states).cast("double")), 3)
    return hypotheses.groupBy("investigation_id").agg(
        F.count(F.lit(1)).alias("hypotheses"),
        share("testable", "supported", "rejected").alias("relevance"),
        share("supported", "rejected").alias("resolution_rate"))


def verification_rates(findings: DataFrame) -> DataFrame:
    """Share of checked findings whose calculation gave the same result again."""
    checked = F.col("verification_status").isin("verified", "failed_verification")
    return findings.groupBy("investigation_id").agg(
        F.count_if(checked).alias("checked"),
        F.round(F.avg(F.when(checked, (F.col("verification_status") == "verified").cast("double"))), 3)
        .alias("accuracy"))


def test_appropriateness(runs: DataFrame, types: DataFrame) -> DataFrame:
    """Per recorded test: whether its columns had the types it needs.

    ``runs`` holds ``id`` and JSON ``parameters``; ``types`` maps ``column`` to ``inferred_type``.
    """
    needs = runs.sparkSession.createDataFrame(
        [(t, a, n) for t, args in REQUIREMENTS.items() for a, n in args.items()],
        "test string, argument string, needed string")
    calls = runs.select("id", F.get_json_object("parameters", "$.test").alias("test"),
                        F.get_json_object("parameters", "$.params").alias("params"))
    used = (calls.join(F.broadcast(needs), "test", "left")
            .withColumn("given", F.from_json("params", "map<string,string>"))
            .withColumn("column", F.try_element_at("given", F.col("argument"))))
    checked = used.join(types.select("column", "inferred_type"), "column", "left")
    fits = F.when(F.col("needed") == "numeric", F.col("inferred_type") == "numeric").otherwise(
        F.col("inferred_type").isin("categorical", "id", "boolean"))
    two = F.from_json(F.get_json_object("params", "$.groups"), "array<string>")
    bad_groups = (F.col("test") == "ttest") & two.isNotNull() & (F.size(two) != 2)
    return checked.groupBy("id", "test").agg(
        (F.bool_and(F.col("needed").isNotNull() & F.coalesce(fits, F.lit(True)))
         & ~F.bool_or(F.coalesce(bad_groups, F.lit(False)))).alias("appropriate"))


def findings_text(findings: DataFrame) -> DataFrame:
    """Lower-cased statements and evidence of each run, with the lead statement.

    The lead is the first driver or association, else the first finding, by ``rank``.
    """
    text = F.concat_ws(" ", F.coalesce("statement", F.lit("")), F.coalesce("evidence_summary", F.lit("")))
    order = F.struct((~F.col("finding_type").isin(*CAUSAL)).cast("int").alias("a"),
                     F.col("rank").alias("b"))
    return findings.groupBy("run_id").agg(
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))),
                                         lambda x: x["t"]), " ")).alias("text"),
        F.lower(F.min_by("statement", order)).alias("lead"))


def root_cause(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per run: does the lead, or anything stated, name the true column or value?

    ``runs`` has ``run_id``, ``true_column``, ``true_value`` and ``answer``.
    """
    done = ((F.coalesce("answer", F.lit("")) != "") & ~F.col("answer").startswith("[error")
            & ~F.col("answer").startswith("[mock"))
    rows = runs.join(findings_text(findings), "run_id", "left").withColumn(
        "completed", F.coalesce(done, F.lit(False)))
    answer = F.when(F.col("completed"), F.lower("answer")).otherwise("")
    hay = F.concat_ws(" ", F.coalesce("text", F.lit("")), answer)
    lead = F.coalesce(F.nullif(F.col("lead"), F.lit("")), answer)

    def names(text: Column) -> Column:
        def one(c: str) -> Column:
            return (F.coalesce(F.length(c), F.lit(0)) > 0) & F.contains(text, F.lower(F.col(c)))
        return F.coalesce(one("true_column"), F.lit(False)) | F.coalesce(one("true_value"), F.lit(False))

    return rows.select("run_id", "completed", (F.col("completed") & names(lead)).alias("rank_1"),
                       (F.col("completed") & names(hay)).alias("found"))


def declined_to_guess(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """For runs without a discoverable cause: asked for evidence and asserted nothing."""
    sure = findings.groupBy("run_id").agg(F.bool_or(
        F.col("finding_type").isin(*CAUSAL) & (F.col("confidence") == "high")).alias("asserted"))
    return runs.join(sure, "run_id", "left").select(
        "run_id", (F.col("completed") & F.col("asked") & ~F.coalesce("asserted", F.lit(False)))
        .alias("correct"))


def evidence_terms(runs: DataFrame) -> DataFrame:
    """Which of the document's ``terms`` the run's ``text`` uses."""
    hits = F.filter("terms", lambda t: F.contains(F.lower(F.col("text")), F.lower(t)))
    return runs.withColumn("terms_used", hits).withColumn("used_document", F.size("terms_used") > 0)


def reported_driver_change(comparisons: DataFrame) -> DataFrame:
    return comparisons.groupBy("investigation_id").agg(
        F.count(F.lit(1)).alias("compared_with"),
        F.bool_or(F.col("driver_change") == "replaced").alias("reported_change"))


def finding_rates(findings: DataFrame) -> DataFrame:
    """Traceable, verified and unsupported shares per investigation."""
    causal = F.col("finding_type").isin(*CAUSAL)
    linked = F.col("tool_run_id").isNotNull()
    return findings.groupBy("investigation_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(causal).alias("causal_claims"),
        F.count_if(F.col("verification_status") == "verified").alias("verified"),
        F.round(F.avg(linked.cast("double")), 3).alias("traceability_rate"),
        F.coalesce(F.round(F.avg(F.when(causal, (~linked).cast("double"))), 3), F.lit(0.0))
        .alias("unsupported_claim_rate"))


def action_match(runs: DataFrame) -> DataFrame:
    """Whether enough longer words of the best known action appear in what was recommended."""
    long_words = F.filter(F.split(F.lower("best_action"), r"\s+"), lambda w: F.length(w) > 4)
    hits = F.size(F.filter(long_words, lambda w: F.contains(F.lower(F.col("recommended")), w)))
    need = F.greatest(F.lit(1), F.floor(F.size(long_words) / 3))
    return runs.withColumn("matches", (F.size(long_words) > 0) & (hits >= need))


def system_rollup(scores: DataFrame) -> DataFrame:
    """Means per system over its scenarios; missing measures are left out of their mean."""
    flags = ("rank_1", "found", "completed")
    means = [c for c in scores.columns if c not in ("system", "scenario", *flags)]
    return scores.groupBy("system").agg(
        F.count(F.lit(1)).alias("scenarios"),
        *[F.round(F.avg(F.coalesce(F.col(c).cast("int"), F.lit(0))), 3).alias(f"{c}_rate")
          for c in flags],
        *[F.round(F.avg(F.col(c).cast("double")), 3).alias(f"avg_{c}") for c in means])


def feedback_rates(feedback: DataFrame) -> DataFrame:
    """Adoption share and mean rating of recommendations."""
    return feedback.where(F.col("target_type") == "recommendation").agg(
        F.count(F.lit(1)).alias("feedback"),
        F.round(F.avg(F.coalesce("was_adopted", F.lit(False)).cast("double")), 3).alias("adoption_rate"),
        F.round(F.avg("rating"), 2).alias("mean_rating"))
