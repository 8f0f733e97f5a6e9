"""Which group drove the change of a metric between two periods."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inquest.functions.exactsums import exact_sum, steady_sum
from inquest.functions.dates import parsed_column, with_spine
from inquest.functions.quantiles import quantile_values
from inquest.functions.tables import long_form, require_columns, spread
from inquest.operators.changepoints import change_points

MIN_STRENGTH, FALLBACK_QUANTILE = 0.25, 0.67


@dataclass(frozen=True)
class Split:
    """The boundary between the two periods and how it was chosen."""

    cutoff: dt.datetime
    method: str
    strength: float | None
    before_months: int
    after_months: int
    before_rows: int
    after_rows: int

    @property
    def date(self) -> str:
        return str(self.cutoff.date())


def dated_rows(df: DataFrame, date: str, *others: str) -> DataFrame:
    """``ts`` and other columns of the rows whose date can be read."""
    require_columns(df, date, *others)
    return (df.select(parsed_column(df, date).alias("ts"),
                      *[F.col(f"`{c}`") for c in dict.fromkeys(others)])
            .where("ts IS NOT NULL"))


def date_quantile(df: DataFrame, date: str, q: float = FALLBACK_QUANTILE) -> dt.datetime:
    """The moment below which the share ``q`` of the rows lies."""
    micros = dated_rows(df, date).select(F.unix_micros("ts").alias("micros"))
    value = quantile_values(micros, ["micros"], [q])["micros"][0]
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=round(value))


def resolve_split(df: DataFrame, date: str, metric: str,
                  split: str | dt.datetime | None = None) -> Split:
    """Use the given date, else a detected level change, else the last third of the rows."""
    rows = dated_rows(df, date, metric)
    method, strength = "supplied", None
    if split is None:
        monthly = (rows.groupBy(F.trunc("ts", "month").alias("period"))
                   .agg(F.coalesce(steady_sum(rows, metric), F.lit(0)).cast("double").alias("value")))
        series = with_spine(monthly, [], "period", "MS").fillna(0.0, ["value"])
        found = change_points(series).collect()
        if not found:
            raise ValueError("No parseable dates in the date column")
        strength = found[0]["strength"]
        if found[0]["change_period"] is not None and strength >= MIN_STRENGTH:
            cutoff, method = dt.datetime.combine(found[0]["change_period"], dt.time()), "detected"
        else:
            cutoff, method = date_quantile(df, date), "fallback"
    else:
        cutoff = pd.Timestamp(split).to_pydatetime()
    sides = {r["late"]: r for r in (
        rows.groupBy((F.col("ts") >= F.lit(cutoff.isoformat(" ")).cast("timestamp")).alias("late"))
        .agg(F.count_distinct(F.trunc("ts", "month")).alias("months"),
             F.count(F.lit(1)).alias("rows")).collect())}
    if False not in sides or True not in sides:
        raise ValueError("The split produced an empty period")
    return Split(cutoff, method, strength, sides[False]["months"], sides[True]["months"],
                 sides[False]["rows"], sides[True]["rows"])


def period_sums(df: DataFrame, date: str, metric: str, dimensions: list[str],
                split: Split) -> DataFrame:
    """``dimension``, ``group``, and the metric's sum on either side; no missing labels."""
    rows = dated_rows(df, date, metric, *dimensions)
    late = F.col("ts") >= F.lit(split.cutoff.isoformat(" ")).cast("timestamp")
    marked = rows.select(late.alias("late"), F.col(f"`{metric}`").cast("double").alias("m"),
                         *[F.col(f"`{d}`") for d in dict.fromkeys(dimensions)])
    cells = long_form(marked, dimensions, "string", ["late", "m"], "dimension", "group")
    return (cells.where("`group` IS NOT NULL").groupBy("dimension", "group")
            .agg(F.coalesce(exact_sum(F.when(~F.col("late"), F.col("m"))), F.lit(0.0)).alias("before"),
                 F.coalesce(exact_sum(F.when(F.col("late"), F.col("m"))), F.lit(0.0)).alias("after")))


def period_contribution(df: DataFrame, date: str, metric: str, by: str | list[str],
                        split: str | dt.datetime | Split | None = None) -> DataFrame:
    """Each group's change per month and its share of the whole change.

    Several columns in ``by`` are answered in the same pass, one ``dimension`` each.
    """
    dimensions = [by] if isinstance(by, str) else list(by)
    if not isinstance(split, Split):
        split = resolve_split(df, date, metric, split)
    groups = period_sums(df, date, metric, dimensions, split).select(
        "dimension", "group",
        (F.col("before") / split.before_months).alias("prev"),
        (F.col("after") / split.after_months).alias("curr"),
        (F.col("after") / split.after_months
         - F.col("before") / split.before_months).alias("change"))
    # one row per column of the table, so the broadcast is bounded by the schema
    totals = groups.groupBy("dimension").agg(
        exact_sum(F.col("change")).alias("total"), exact_sum(F.col("prev")).alias("total_prev"),
        F.count(F.lit(1)).alias("groups"))
    share = F.when(F.col("total") != 0, F.col("change") / F.col("total") * 100).otherwise(0.0)
    return (
        groups.join(F.broadcast(totals), "dimension")
        .select(
            "dimension", "group",
            F.round("prev", 2).alias("previous_per_period"),
            F.round("curr", 2).alias("current_per_period"),
            F.round("change", 2).alias("change"),
            F.when(F.col("prev") != 0, F.round(F.col("change") / F.col("prev") * 100, 2))
            .alias("change_pct"),
            F.round(share, 2).alias("contribution_to_total_change_pct"),
            F.when(F.col("total") < 0, "decline").otherwise("increase").alias("direction"),
            F.round("total", 2).alias("total_change_per_period"),
            F.when(F.col("total_prev") != 0,
                   F.round(F.col("total") / F.col("total_prev") * 100, 2)).alias("total_change_pct"),
            "groups",
            F.lit(split.date).alias("split_date"), F.lit(split.method).alias("split_method"),
            F.round(F.lit(split.strength).cast("double"), 3).alias("split_strength"))
        .orderBy("dimension", F.desc("contribution_to_total_change_pct"), "group"))


def leading_group(contributions: DataFrame, dimension: str) -> dict | None:
    top = (contributions.where(F.col("dimension") == dimension)
           .orderBy(F.desc("contribution_to_total_change_pct"), "group").limit(1).collect())
    return top[0].asDict() if top else None


def interaction_contribution(df: DataFrame, date: str, metric: str, by: list[str],
                             split: str | dt.datetime | None = None) -> DataFrame:
    """How the leading group of ``by[0]`` splits across ``by[1]`` over the same periods."""
    if len(by) < 2:
        raise ValueError("interaction_contribution needs two columns in 'by'")
    primary, secondary = by[0], by[1]
    outer = period_contribution(df, date, metric, primary, split)
    lead = leading_group(outer, primary)
    if lead is None:
        raise ValueError("No groups to analyse")
    inside = df.where(F.col(f"`{primary}`").cast("string") == lead["group"])
    inner = period_contribution(inside, date, metric, secondary, lead["split_date"])
    top = F.col("top.contribution_to_total_change_pct")
    even = F.lit(100.0) / F.col("groups")
    best = inner.agg(F.max_by(F.struct("group", "contribution_to_total_change_pct"),
                              F.struct("contribution_to_total_change_pct")).alias("top"))
    concentrated = (F.col("groups") > 1) & (top > F.greatest(F.lit(80.0), even * 2.5))
    return (
        inner.withColumn("top", best.scalar())
        .select(F.lit(lead["group"]).alias("leading_group"),
                F.lit(lead["contribution_to_total_change_pct"]).alias("leading_group_share_pct"),
                F.lit(lead["direction"]).alias("direction"),
                "group", "previous_per_period", "current_per_period", "change", "change_pct",
                "contribution_to_total_change_pct",
                F.col("groups").alias("values_examined"), concentrated.alias("worth_reporting"),
                F.when(concentrated, F.concat(F.lit(lead["group"]), F.lit(" × "),
                                              F.col("top.group"))).alias("refined_to"),
                "split_date")
        .orderBy(F.desc("contribution_to_total_change_pct"), "group"))


def seasonal_check(df: DataFrame, date: str, metric: str, by: str | list[str], cutoff: str,
                   only: dict[str, str] | None = None) -> DataFrame:
    """Each group's months after the cutoff against the same months a year earlier.

    ``only`` names the one group of each column that matters.
    """
    dimensions = [by] if isinstance(by, str) else list(by)
    cells = long_form(dated_rows(df, date, metric, *dimensions), dimensions, "string", ["ts", metric],
                      "dimension", "group").where("`group` IS NOT NULL")
    if only:
        chosen = F.lit(False)
        for d, g in only.items():
            chosen = chosen | ((F.col("dimension") == d) & (F.col("group") == g))
        cells = cells.where(chosen)
    keys = ["dimension", "group"]
    monthly = (cells.groupBy(*keys, F.trunc("ts", "month").alias("period"))
               .agg(F.coalesce(steady_sum(df, metric), F.lit(0)).cast("double").alias("value")))
    series = with_spine(monthly, keys, "period", "MS").fillna(0.0, ["value"])
    late = F.col("n.period").cast("timestamp") >= F.lit(cutoff).cast("timestamp")
    paired = series.alias("n").join(
        series.alias("p"), (F.col("n.dimension") == F.col("p.dimension"))
        & (F.col("n.group") == F.col("p.group"))
        & (F.col("p.period") == F.add_months(F.col("n.period"), -12)), "left")
    has_pair = late & F.col("p.period").isNotNull()
    sums = paired.groupBy(F.col("n.dimension").alias("dimension"), F.col("n.group").alias("group")).agg(
        F.count(F.lit(1)).alias("months"), F.count_if(has_pair).alias("pairs"),
        F.sum(F.when(has_pair, F.col("p.value"))).alias("last"),
        F.sum(F.when(has_pair, F.col("n.value"))).alias("this"))
    checked = (F.col("months") >= 24) & (F.col("pairs") >= 2)
    yoy = F.when(F.col("last") != 0, (F.col("this") - F.col("last")) / F.col("last") * 100)
    return sums.select(
        "dimension", "group", "months", checked.alias("checked"),
        F.when(checked, F.col("pairs")).alias("months_compared"),
        F.when(checked, F.round("last", 2)).alias("same_months_last_year"),
        F.when(checked, F.round("this", 2)).alias("same_months_this_year"),
        F.when(checked, F.round(yoy, 2)).alias("year_on_year_pct"),
        F.when(checked, F.coalesce(yoy < -5, F.lit(False))).alias("survives"))


# --- bootstrap ---------------------------------------------------------------

_TABLE_LIMIT = 64
KEYS_PER_TASK = 1 << 20


def _hashes(keys: np.ndarray, draws: int) -> np.ndarray:
    """Sixteen reproducible bits per key and draw (splitmix64 finaliser, four draws a word)."""
    steps = np.arange(1, -(-draws // 4) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + steps[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return z.view(np.uint16)[:, :draws]


def _poisson_table(mean: float) -> np.ndarray:
    """The Poisson value for each of 65,536 equally likely cases."""
    k = np.arange(int(mean + 12 * np.sqrt(mean) + 20))
    steps = np.concatenate([[0.0], np.log(mean) - np.log(k[1:])])
    cdf = np.cumsum(np.exp(np.cumsum(steps) - mean))
    return np.searchsorted(cdf, (np.arange(65536) + 0.5) / 65536).astype(np.float64)


def poisson_weights(keys: np.ndarray, counts: np.ndarray, draws: int,
                    tables: dict | None = None) -> np.ndarray:
    """How often each counted row is drawn: Poisson with the row's count as its mean."""
    tables = {} if tables is None else tables
    weights = np.empty((len(keys), draws))
    for c in np.unique(counts):
        at = np.flatnonzero(counts == c)
        if c <= _TABLE_LIMIT:
            if c not in tables:
                tables[c] = _poisson_table(float(c))
            weights[at] = tables[c][_hashes(keys[at], draws)]
        else:
            for i in at:
                rng = np.random.default_rng(int(keys[i]) & 0xFFFFFFFFFFFFFFFF)
                weights[i] = rng.poisson(float(c), draws)
    return weights


def _partial_sums(draws: int, flush: int = 2000):
    """Per task: add up weighted values per group and side before anything is shuffled."""
    def run(batches):
        sums: dict = {}
        tables: dict = {}

        def rows():
            return pd.DataFrame({
                "dimension": [k[0] for k in sums], "group": [k[1] for k in sums],
                "late": [k[2] for k in sums], "wv": [v[0] for v in sums.values()],
                "w": [v[1] for v in sums.values()]})

        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo:lo + 2000]
                values = part["m"].to_numpy(dtype=float)
                w = poisson_weights(part["h"].to_numpy(), part["c"].to_numpy(), draws, tables)
                keyed = part.groupby(["dimension", "group", "late"], dropna=False, sort=False)
                for key, at in keyed.indices.items():
                    key = (key[0], None if pd.isna(key[1]) else key[1], bool(key[2]))
                    old = sums.get(key, (0.0, 0.0))
                    sums[key] = (old[0] + values[at] @ w[at], old[1] + w[at].sum(axis=0))
                if len(sums) >= flush:
                    yield rows()
                    sums.clear()
        if sums:
            yield rows()
    return run


def _counted(rows: DataFrame, dimensions: list[str], tasks: int, needed: int) -> DataFrame:
    """``dimension, group, late, m, c``: equal rows counted, in more tasks if more are needed."""
    key = ["dimension", "group", "late", "m"]
    if needed <= tasks:
        return (long_form(spread(rows), dimensions, "string", ["late", "m"], "dimension", "group")
                .groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
                # many draws per row: keep the tasks that adaptive execution would merge
                .repartition(tasks))
    names = [f"d{i}" for i in range(len(dimensions))]
    some = rows.select("late", "m", *[F.col(f"`{d}`").cast("string").alias(n) for n, d in zip(names, dimensions)])

    def run(batches):
        """Equal rows of a batch as one, so that copies of a row do not travel to one task."""
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from (table.group_by(["late", "m", *names]).aggregate([([], "count_all")])
                        .select(["late", "m", *names, "count_all"])
                        .rename_columns(["late", "m", *names, "n"]).to_batches())
    fewer = some.mapInArrow(run, "late boolean, m double, " + "".join(f"{n} string, " for n in names) + "n long")
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(n).alias("group"))
                      for n, d in zip(names, dimensions)])
    return (fewer.repartition(needed, "late", "m").select("late", "m", "n", F.explode(cells).alias("cell"))
            .select("cell.dimension", "cell.group", "late", "m", "n")
            .groupBy(*key).agg(F.sum("n").alias("c")))


def contribution_intervals(df: DataFrame, date: str, metric: str, by: str | list[str],
                           split: Split, draws: int = 200, least: int = 30,
                           keys_per_task: int = KEYS_PER_TASK) -> DataFrame:
    """A 95 % bootstrap interval around each group's share of the change.

    Equal rows are counted first, so a row is (group, side, value) with a count and
    its weights follow from a hash of that key: no random state, and the same
    result under any partitioning. Sums are rescaled to the real number of rows. A task
    counts about ``keys_per_task`` different keys at most.
    """
    dimensions = [by] if isinstance(by, str) else list(by)
    late = F.col("ts") >= F.lit(split.cutoff.isoformat(" ")).cast("timestamp")
    rows = (dated_rows(df, date, metric, *dimensions).where(F.col(f"`{metric}`").isNotNull())
            .select(late.alias("late"), F.col(f"`{metric}`").cast("double").alias("m"),
                    F.trunc("ts", "month").alias("month"), *[F.col(f"`{d}`") for d in dimensions]))
    spans = {r["late"]: r for r in rows.groupBy("late").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("month").alias("months"),
        F.approx_count_distinct(F.struct("m", *[F.col(f"`{d}`") for d in dimensions])).alias("keys")).collect()}
    schema = "dimension string, `group` string, low double, high double, draws long"
    if any(side not in spans or spans[side]["rows"] < least for side in (False, True)):
        return df.sparkSession.createDataFrame([], schema)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-sum(r["keys"] for r in spans.values()) * len(dimensions) // keys_per_task)
    counted = _counted(rows.drop("month"), dimensions, tasks, needed).withColumn(
        "h", F.xxhash64("dimension", "group", "late", "m"))
    partial = counted.mapInPandas(
        _partial_sums(draws),
        "dimension string, `group` string, late boolean, wv array<double>, w array<double>")
    by_draw = (partial.select("dimension", "group", "late", F.posexplode("wv").alias("draw", "wv"),
                              "w")
               .select("dimension", "group", "late", "draw", "wv",
                       F.col("w")[F.col("draw")].alias("w"))
               .groupBy("dimension", "group", "draw")
               .agg(*[F.coalesce(F.sum(F.when(F.col("late") == side, F.col(x))), F.lit(0.0))
                      .alias(f"{x}_{name}")
                      for x in ("wv", "w") for side, name in ((False, "b"), (True, "a"))]))
    # one row per dimension and draw
    totals = by_draw.groupBy("dimension", "draw").agg(
        *[F.sum(c).alias(f"all_{c}") for c in ("wv_b", "wv_a", "w_b", "w_a")])
    scale_b = F.lit(float(spans[False]["rows"])) / F.col("all_w_b") / spans[False]["months"]
    scale_a = F.lit(float(spans[True]["rows"])) / F.col("all_w_a") / spans[True]["months"]
    total = F.col("all_wv_a") * scale_a - F.col("all_wv_b") * scale_b
    moved = F.col("wv_a") * scale_a - F.col("wv_b") * scale_b
    shares = (by_draw.where("`group` IS NOT NULL").join(F.broadcast(totals), ["dimension", "draw"])
              .select("dimension", "group", F.when(total != 0, moved / total * 100).alias("share")))
    return (shares.where("share IS NOT NULL").groupBy("dimension", "group")
            .agg(F.percentile("share", F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
                 F.count("share").alias("draws"))
            .where(F.col("draws") >= draws // 2)
            .select("dimension", "group", F.round(F.col("q")[0], 1).alias("low"),
                    F.round(F.col("q")[1], 1).alias("high"), "draws"))


def split_periods(df: DataFrame, date: str) -> DataFrame:
    """Default comparison: the most recent third of the rows against all before it."""
    dates = dated_rows(df, date)
    ends = dates.agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("date").alias("first"),
                     F.max("ts").cast("date").alias("last"))
    cutoff = date_quantile(df, date).date() if dates.limit(10).count() >= 10 else None
    return ends.where("n >= 10").select(
        F.lit(cutoff).alias("current_start"), F.col("last").alias("current_end"),
        F.col("first").alias("previous_start"), F.lit(cutoff).alias("previous_end"))
