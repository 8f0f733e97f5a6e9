"""Checking a join key before it is used, finding one, and the enrichment join."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from inquest.functions.tables import BROADCAST_ROWS, require_columns
from inquest.operators.profiling import column_facts


def _key_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows per key, counted before anything is joined, so a hot key is one row."""
    return df.groupBy(F.col(f"`{key}`").cast("string").alias("key")).agg(
        F.count(F.lit(1)).alias(name))


def key_matches(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """One row: rows, keys, repeats, missing keys and matches of both sides."""
    require_columns(left, on)
    require_columns(right, on)
    both = _key_counts(left, on, "l").join(_key_counts(right, on, "r"), "key", "full_outer")
    present = F.col("key").isNotNull()
    in_left, in_right = present & F.col("l").isNotNull(), present & F.col("r").isNotNull()
    return both.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count_if(in_left & in_right).alias("matched_keys"),
        F.count_if(in_left & ~in_right).alias("unmatched_left_keys"),
        F.count_if(in_right & ~in_left).alias("unmatched_right_keys"),
        (F.count_if(in_left & (F.col("l") > 1)) == 0).alias("left_key_unique"),
        (F.count_if(in_right & (F.col("r") > 1)) == 0).alias("right_key_unique"),
        (F.count_if(~present) > 0).alias("missing_keys"))


def validate_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """``key_matches`` with a cardinality, a match rate, the problems and ``safe``."""
    lu, ru = F.col("left_key_unique"), F.col("right_key_unique")
    keys = F.col("matched_keys") + F.col("unmatched_left_keys")
    rate = F.col("matched_keys") / F.greatest(keys, F.lit(1))
    problems = F.array_compact(F.array(
        F.when(~lu & ~ru, "many-to-many: rows would multiply"),
        F.when(F.col("matched_keys") == 0, "no key matches")
        .when(rate < 0.5, "fewer than half of the base keys match"),
        F.when(F.col("missing_keys"), "the key contains missing values")))
    return (
        key_matches(left, right, on)
        .withColumn("key", F.lit(on))
        .withColumn("cardinality", F.when(lu & ru, "one-to-one").when(ru, "many-to-one")
                    .when(lu, "one-to-many").otherwise("many-to-many"))
        .withColumn("match_rate", F.round(rate, 4))
        .withColumn("problems", problems)
        .withColumn("safe", F.size("problems") == 0)
        .drop("missing_keys"))


def key_scores(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """``column`` and ``score``: key overlap weighted by how unique the right side is."""
    scored = None
    for c in columns:
        m = key_matches(left, right, c)
        keys = F.col("matched_keys") + F.col("unmatched_left_keys")
        right_keys = F.col("matched_keys") + F.col("unmatched_right_keys")
        unique = right_keys / F.greatest(F.col("right_rows"), F.lit(1))
        usable = (keys > 0) & (right_keys > 0)
        row = m.select(F.lit(c).alias("column"), F.when(
            usable, F.col("matched_keys") / keys * (0.5 + 0.5 * unique)).otherwise(0.0).alias("score"))
        scored = row if scored is None else scored.unionByName(row)
    return scored


def suggest_join_key(left: DataFrame, right: DataFrame) -> str | None:
    """A shared date column, else the shared id or category that matches best."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return None
    now = dt.datetime(2000, 1, 1)
    kinds = {side: {c: f.inferred for c, f in column_facts(
        df.select(*[f"`{c}`" for c in shared]), now).items()}
        for side, df in (("left", left), ("right", right))}
    for c in shared:
        if kinds["left"][c] == kinds["right"][c] == "datetime":
            return c
    usable = [c for c in shared if kinds["left"][c] in ("id", "categorical")]
    if not usable:
        return None
    ranked = {r["column"]: r["score"] for r in key_scores(left, right, usable).collect()}
    best = max(usable, key=lambda c: ranked[c])
    return best if ranked[best] >= 0.5 else None


def enrich(base: DataFrame, extra: DataFrame, on: str | None = None,
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The base table with the new columns of a validated supplementary table.

    The supplementary side is broadcast only after its rows were counted; a larger one
    is shuffled, where adaptive execution splits a hot key of the base.
    """
    on = on or suggest_join_key(base, extra)
    if on is None:
        raise ValueError("No usable join key. Supply a table sharing a date or an identifier.")
    check = validate_join(base, extra, on).first()
    if not check["safe"]:
        raise ValueError(f"The join on '{on}' is not safe: {'; '.join(check['problems'])}")
    added = [c for c in extra.columns if c != on and c not in base.columns]
    if not added:
        raise ValueError(f"The supplied table adds no column beyond '{on}'")
    side = extra.select(f"`{on}`", *[f"`{c}`" for c in added])
    if check["right_rows"] <= broadcast_rows:
        side = F.broadcast(side)
    return base.join(side, on, "left").select(*[f"`{c}`" for c in [*base.columns, *added]])
