"""Rules that turn measurements into findings, comparisons and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inquest.constants import CONFIDENCE_WEIGHT, RECOVERY, URGENCY_WEIGHT

MATERIAL_PCT, CONCENTRATION, COHERENT_PCT = 5, 1.6, 150
EVEN_PCT = 2               # an even share counts as at least this, however many groups there are
UNRANKED_UNITS = ("correlation coefficient", "")


def by_word(word: Column, values: dict, default) -> Column:
    chain = None
    for k, v in values.items():
        chain = F.when(F.lower(word) == k, v) if chain is None else chain.when(F.lower(word) == k, v)
    return chain.otherwise(default)


def driver_tests(contributions: DataFrame) -> DataFrame:
    """One row per dimension: its leading group, and whether that group drove the change.

    The movement must be material, the group must carry clearly more than an even
    share, and a share far above 100 % means that groups cancelled out.
    """
    order = Window.partitionBy("dimension").orderBy(
        F.desc("contribution_to_total_change_pct"), "group")
    two = (contributions.withColumn("k_", F.row_number().over(order)).where("k_ <= 2")
           .groupBy("dimension").agg(
        F.max_by(F.struct(*contributions.columns), -F.col("k_")).alias("top"),
        F.max(F.when(F.col("k_") == 2, F.col("group"))).alias("runner_up")))
    rows = two.select("top.*", "runner_up")
    share = F.col("contribution_to_total_change_pct")
    even = F.greatest(F.lit(100.0) / F.col("groups"), F.lit(float(EVEN_PCT)))
    material = F.abs(F.coalesce("total_change_pct", F.lit(0.0))) >= MATERIAL_PCT
    concentrated, coherent = share >= even * CONCENTRATION, share <= COHERENT_PCT
    supported = material & concentrated & coherent
    return rows.select(
        "*", F.round(F.lit(100.0) / F.col("groups"), 1).alias("even_share_pct"), supported.alias("supported"),
        F.when(supported, F.round(F.least(share / 100, F.lit(0.95)), 2)).otherwise(0.2)
        .alias("confidence"),
        F.when(~material, "the overall movement is too small").when(
            ~coherent, "groups moved in opposite directions and cancelled out").when(
            ~concentrated, "no group carries a disproportionate share").alias("reject_reason"))


def size_tests(totals: DataFrame) -> DataFrame:
    """Without dates: whether the largest group holds clearly more than an even share."""
    share = F.col("top.share_pct")
    best = totals.agg(F.max_by(F.struct("group", "value", "share_pct"), "value").alias("top"),
                      F.count(F.lit(1)).alias("groups"))
    supported = share >= F.lit(100.0) / F.col("groups") * CONCENTRATION
    return best.select("top.*", "groups", supported.alias("supported"),
                       F.when(supported, F.round(F.least(share / 100, F.lit(0.9)), 2)).otherwise(0.2)
                       .alias("confidence"))


def trend_test(series: DataFrame) -> DataFrame:
    """Movement from the first to the last period; a measurement when above ten percent."""
    present = series.where("value IS NOT NULL")
    ends = present.agg(F.count(F.lit(1)).alias("points"),
                       F.min_by("value", "period").alias("first"),
                       F.max_by("value", "period").alias("last"))
    change = F.col("last") - F.col("first")
    pct = F.when(F.col("first") != 0, change / F.col("first") * 100).otherwise(0.0)
    return ends.where("points >= 3").select(
        "points", "first", "last", change.alias("change"), pct.alias("change_pct"),
        (F.abs(pct) > 10).alias("supported"))


def driver_confidence(share: Column, significant: Column, checked: Column, survives: Column) -> Column:
    """Low when the same months a year earlier explain it, high when large and significant."""
    return (F.when(F.coalesce(checked, F.lit(False)) & ~F.coalesce(survives, F.lit(False)), "low")
            .when((share > 50) & F.coalesce(significant, F.lit(False)), "high").otherwise("medium"))


def rank_findings(findings: DataFrame) -> DataFrame:
    """Drivers first, refined ones before broad ones, then confidence and size."""
    kind = by_word(F.col("finding_type"), {"driver": 0, "association": 1, "measurement": 2}, 3)
    sure = by_word(F.col("confidence"), {"high": 0, "medium": 1, "low": 2}, 3)
    refined = F.when(F.coalesce("evidence_summary", F.lit("")).startswith("interaction_contribution"),
                     0).otherwise(1)
    order = Window.partitionBy("investigation_id").orderBy(
        kind, refined, sure, F.desc(F.abs(F.coalesce("magnitude", F.lit(0.0)))), "statement")
    return findings.withColumn("rank", F.row_number().over(order))


def soften_correlations(findings: DataFrame) -> DataFrame:
    """A correlation is never reported with high confidence."""
    too_sure = (F.col("confidence") == "high") & F.lower("statement").contains("correlation")
    return findings.withColumn("confidence", F.when(too_sure, "medium").otherwise(F.col("confidence")))


def open_concerns(concerns: Column, evidence: Column) -> Column:
    """Objections left after those about seasonality that the evidence answers."""
    answered = F.lower(evidence).contains("calendar months a year earlier")
    return F.filter(concerns, lambda c: ~(answered & F.lower(c).contains("seasonality")
                                          & F.lower(c).contains("not been ruled out")))


def evidence_gaps(findings: DataFrame) -> DataFrame:
    """Investigations that measured a change but found no driver for it."""
    return (findings.groupBy("investigation_id").agg(
        F.bool_or(F.col("finding_type") == "measurement").alias("measured"),
        F.bool_or(F.col("finding_type") == "driver").alias("explained"))
        .where("measured AND NOT explained").select("investigation_id"))


def missing_columns(hypotheses: DataFrame, available: list[str]) -> DataFrame:
    """``missing`` columns and the resulting status of every hypothesis."""
    have = F.array(*[F.lit(c) for c in available]) if available else F.array().cast("array<string>")
    missing = F.array_sort(F.array_except("columns", have))
    return hypotheses.withColumn("missing", missing).withColumn(
        "status", F.when((F.size("columns") == 0) | (F.size("missing") > 0),
                         "blocked_missing_evidence").otherwise("testable"))


def eligible(findings: DataFrame, require_verified: bool = True) -> DataFrame:
    """Only verified drivers with a unit to act on can carry a recommendation."""
    keep = (F.col("finding_type") == "driver") & ~F.lower(F.coalesce("unit", F.lit(""))).isin(
        *UNRANKED_UNITS)
    return findings.where(keep & (F.col("verification_status") == "verified")
                          if require_verified else keep)


def recommendations(findings: DataFrame, forecasts: DataFrame, feedback: DataFrame | None = None,
                    require_verified: bool = True) -> DataFrame:
    """Ranked actions with an impact range: the measured gap times an assumed recovery.

    ``feedback`` adds, per driver key, how similar actions were rated before.
    """
    f = eligible(findings, require_verified).select(
        "investigation_id", F.col("id").alias("finding_id"), "statement", "evidence_summary",
        "magnitude", "unit", "confidence")
    p = forecasts.select("finding_id", "reliability", "predictions",
                         F.col("id").alias("forecast_id"))
    joined = f.join(p, "finding_id", "left")
    points = F.transform("predictions", lambda x: x["point"])
    usable = (F.col("reliability") == "ok") & (F.size(points) > 0)
    ahead = F.when(usable, F.greatest(F.lit(0.0), F.element_at(points, 1) - F.array_min(points))
                   ).otherwise(0.0)
    falls = usable & (F.size(points) > 1) & (F.element_at(points, -1) < F.element_at(points, 1))
    gap = F.abs(F.coalesce("magnitude", F.lit(0.0))) + ahead
    low = by_word(F.col("confidence"), {k: v[0] for k, v in RECOVERY.items()}, RECOVERY["medium"][0])
    high = by_word(F.col("confidence"), {k: v[1] for k, v in RECOVERY.items()}, RECOVERY["medium"][1])
    sized = (joined.withColumn("gap", gap).withColumn("impact_low", F.round(F.col("gap") * low, 2))
             .withColumn("impact_high", F.round(F.col("gap") * high, 2))
             .withColumn("addressable_gap", F.round("gap", 2))
             .withColumn("urgency", F.when(F.coalesce(falls, F.lit(False)), "high").otherwise("medium"))
             .withColumn("score", (F.col("impact_low") + F.col("impact_high")) / 2
                         * by_word(F.col("confidence"), CONFIDENCE_WEIGHT, 0.65)
                         * by_word(F.col("urgency"), URGENCY_WEIGHT, 0.7)))
    note = F.lit("")
    if feedback is not None:
        sized = sized.withColumn("driver_key", driver_key(F.col("statement"))).join(
            feedback, "driver_key", "left")
        note = F.when(F.col("matched") > 0, F.concat(
            F.lit(" A similar action was rated useful in "), "useful", F.lit(" of "), "matched",
            F.lit(" past investigation(s)."))).otherwise("")
    order = Window.partitionBy("investigation_id").orderBy(F.desc("score"), "finding_id")
    return sized.select(
        "investigation_id", "finding_id", F.row_number().over(order).alias("rank"),
        F.concat(F.lit("Address the driver: "), "statement").alias("action"),
        F.concat(F.coalesce("evidence_summary", F.lit("")), note).alias("rationale"),
        "impact_low", "impact_high", "addressable_gap",
        F.coalesce("unit", F.lit("units of the target metric")).alias("unit"),
        F.concat(F.lit("addressable gap x assumed recovery of "), F.round(low * 100, 0).cast("int"),
                 F.lit("-"), F.round(high * 100, 0).cast("int"),
                 F.lit("% for this confidence; a scenario, not a measured effect")).alias("impact_method"),
        "confidence", "urgency", "score")


def driver_key(statement: Column) -> Column:
    """What past actions are matched on: the text before the equals sign."""
    return F.lower(F.trim(F.element_at(F.split(statement, "="), 1)))


def past_feedback(feedback: DataFrame, recs: DataFrame, findings: DataFrame, drivers: list[str],
                  newest: int = 200, examples: int = 20) -> DataFrame:
    """Per driver key: how recommendations on similar findings were rated.

    Looks at the newest 200 ratings, which bounds everything after the limit.
    """
    rows = (feedback.where(F.col("target_type") == "recommendation").alias("f")
            .join(recs.alias("r"), F.col("f.target_id") == F.col("r.id"))
            .join(findings.alias("d"), F.col("r.finding_id") == F.col("d.id"), "left")
            .select(F.lower(F.coalesce(F.nullif(F.col("d.statement"), F.lit("")), "r.action",
                                       F.lit(""))).alias("statement"),
                    F.col("r.action").alias("action"), F.col("f.comment").alias("comment"),
                    F.coalesce("f.was_adopted", F.lit(False)).alias("was_adopted"),
                    F.col("f.recorded_at").alias("at"), F.col("f.id").alias("fid"))
            .orderBy(F.desc("at"), "fid").limit(newest))
    keys = F.array_distinct(F.array(*[driver_key(F.lit(d)) for d in drivers]))
    hits = rows.withColumn("driver_key", F.explode(F.filter(
        keys, lambda k: (k != "") & F.contains(F.col("statement"), k))))
    listed = F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros("at")).alias("age"), "fid", "action", "was_adopted", "comment")))
    return hits.groupBy("driver_key").agg(
        F.count(F.lit(1)).alias("matched"), F.count_if("was_adopted").alias("useful"),
        F.count_if(~F.col("was_adopted")).alias("not_useful"),
        F.transform(F.slice(listed, 1, examples), lambda x: F.struct(
            x["action"].alias("action"), x["was_adopted"].alias("was_adopted"),
            x["comment"].alias("comment"))).alias("examples"))


def compare_investigations(investigations: DataFrame, findings: DataFrame, current_id: str,
                           previous: int = 3) -> DataFrame:
    """The newest complete runs on the same dataset, and whether the driver changed.

    ``investigations`` needs ``id``, ``dataset_id``, ``question``, ``status`` and ``recorded_at``.
    """
    dataset = investigations.where(F.col("id") == current_id).select("dataset_id")
    earlier = (investigations.join(dataset, "dataset_id", "left_semi")
               .where((F.col("id") != current_id) & (F.col("status") == "complete"))
               .orderBy(F.desc("recorded_at"), "id").limit(previous)
               .select(F.col("id").alias("previous_id"), F.col("question").alias("previous_question")))
    key = F.element_at(F.split("statement", " contributed"), 1)
    drivers = (findings.where(F.col("finding_type") == "driver").groupBy("investigation_id")
               .agg(F.sort_array(F.collect_set(key)).alias("keys")))
    none = F.array().cast("array<string>")
    now = drivers.where(F.col("investigation_id") == current_id).select("keys").scalar()
    rows = (earlier.join(drivers.withColumnRenamed("investigation_id", "previous_id"), "previous_id",
                         "left")
            .select("previous_id", "previous_question",
                    F.coalesce("keys", none).alias("previous_drivers"),
                    F.coalesce(now, none).alias("current_drivers")))
    return rows.withColumn("driver_change", driver_change(F.col("previous_drivers"),
                                                          F.col("current_drivers")))


def driver_change(before: Column, after: Column) -> Column:
    return (F.when((F.size(before) == 0) & (F.size(after) == 0), "stable")
            .when(F.size(after) == 0, "disappeared").when(F.size(before) == 0, "increased")
            .when(F.arrays_overlap(before, after), "stable").otherwise("replaced"))
