"""Column types, statistics and quality issues of a table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from inquest.constants import (AMOUNT_HINTS, CUSTOMER_HINTS, DATE_HINTS, GEOGRAPHY_HINTS, ID_HINTS,
                               OFFSET_PATTERN, PRODUCT_HINTS, SEVERITY_PENALTY, UNIT_PATTERN,
                               UNIT_TOKENS)
from inquest.functions.dates import parsed
from inquest.functions.quantiles import quantile_values
from inquest.functions.strings import collapsed, similarity, strip
from inquest.functions.tables import is_numeric, is_time, long_form, spread
from inquest.operators.anomalies import anomalous_rows, outlier_counts
from inquest.operators.duplicates import duplicate_count
from inquest.session import cut_lineage

MIN_LABEL_CHARS, MAX_LENGTH_GAP, MIN_RATIO = 4, 3, 0.8
SHORT_PAIR = 24           # pairs of labels of together so many characters meet by deletions
PIECE = 512               # labels of a piece of those that hold the same rare neighbours
ORDER_BLOCK = 1_000_000


def hinted(name: str, hints: tuple) -> bool:
    return any(h in name.lower() for h in hints)


def semantic_label(name: str, inferred: str) -> str | None:
    if inferred == "datetime":
        return "date"
    if inferred == "id":
        return "identifier"
    for label, hints in (("geography", GEOGRAPHY_HINTS), ("product", PRODUCT_HINTS),
                         ("customer", CUSTOMER_HINTS), ("measure", AMOUNT_HINTS)):
        if hinted(name, hints):
            return label
    return None


@dataclass
class ColumnFacts:
    """Everything the type, issue and cleaning rules need to know about a column."""

    name: str
    dtype: T.DataType
    rows: int = 0
    present: int = 0
    distinct: int = 0
    repeated_keys: int = 0
    top: list = field(default_factory=list)
    measured: dict = field(default_factory=dict)
    stripped_distinct: int = 0
    collapsed_distinct: int = 0

    @property
    def missing(self) -> int:
        return self.rows - self.present

    @property
    def inferred(self) -> str:
        """First matching rule: stored type, then name hints backed by the values."""
        if self.present == 0:
            return "text"
        if isinstance(self.dtype, T.BooleanType):
            return "boolean"
        if is_time(self.dtype):
            return "datetime"
        share = self.distinct / self.present
        if is_numeric(self.dtype):
            return "id" if hinted(self.name, ID_HINTS) and share > 0.9 else "numeric"
        if hinted(self.name, DATE_HINTS) and self.measured.get("dates", 0) > 0.6 * self.present:
            return "datetime"
        if hinted(self.name, ID_HINTS) and share > 0.9:
            return "id"
        if share < 0.5 and self.distinct <= 50:
            return "categorical"
        return "text" if (self.measured.get("length") or 0) > 50 else "categorical"


def _measures(f: T.StructField, now: dt.datetime, at: int) -> tuple[list, dict]:
    """Columns to derive first and aggregates over them, for one column of the table."""
    c = F.col(f"`{f.name}`")
    if is_numeric(f.dataType):
        return [], {"min": F.min(c).cast("double"), "max": F.max(c).cast("double"),
                    "mean": F.avg(c), "std": F.stddev_samp(c), "negative": F.count_if(c < 0)}
    derived, found = [], {}
    text = c.cast("string")
    if is_time(f.dataType) or hinted(f.name, DATE_HINTS):
        ts, offset = F.col(f"ts_{at}"), F.col(f"offset_{at}")
        derived = [parsed(c, f.dataType).alias(f"ts_{at}"),
                   F.nullif(F.regexp_extract(text, OFFSET_PATTERN, 1), F.lit("")).alias(f"offset_{at}")]
        late = F.lit((now + dt.timedelta(days=365)).isoformat(" ")).cast("timestamp")
        found |= {"dates": F.count(ts), "first": F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss"),
                  "last": F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss"),
                  "future": F.count_if(ts > late),
                  "ancient": F.count_if(ts < F.lit("1900-01-01").cast("timestamp")),
                  # a bounded set: the pattern has four digits at most
                  "offsets": F.sort_array(F.collect_set(F.regexp_replace(offset, ":", ""))),
                  "with_offset": F.count(offset)}
    if isinstance(f.dataType, T.StringType):
        unit = F.lower(F.regexp_extract(text, UNIT_PATTERN, 1))
        derived += [F.when(unit.isin(*UNIT_TOKENS), unit).alias(f"unit_{at}")]
        found |= {"length": F.avg(F.length(text)),
                  "padded": F.count_if(text != strip(text)),
                  "units": F.sort_array(F.collect_set(f"unit_{at}"))}
    elif not is_time(f.dataType):
        found["length"] = F.avg(F.length(text))
    return derived, found


def value_table(df: DataFrame) -> DataFrame:
    """How often each value of each column occurs: ``column``, ``value``, ``n``."""
    return (long_form(spread(df), df.columns, "string").where("value IS NOT NULL")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def column_facts(df: DataFrame, now: dt.datetime | None = None) -> dict[str, ColumnFacts]:
    """Two scans: one wide aggregate, and one table of value counts for the rest."""
    now = now or dt.datetime.now()
    measures = {f.name: _measures(f, now, i) for i, f in enumerate(df.schema)}
    derived = df.select("*", *[d for ds, _ in measures.values() for d in ds])
    row = derived.agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(F.count(f"`{c}`").alias("present"), *[e.alias(k) for k, e in m.items()])
        .alias(f"c{i}") for i, (c, (_, m)) in enumerate(measures.items())]).first()
    facts = {}
    for i, f in enumerate(df.schema):
        measured = row[f"c{i}"].asDict()
        facts[f.name] = ColumnFacts(f.name, f.dataType, row["rows"], measured.pop("present"),
                                    measured=measured)
    values = value_table(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"),
                                              F.count_if(F.col("n") > 1).alias("repeated")).collect():
            facts[r["column"]].distinct = r["distinct"]
            facts[r["column"]].repeated_keys = r["repeated"]
        ranked = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        for r in (values.withColumn("k", F.row_number().over(ranked)).where("k <= 10")
                  .orderBy("column", "k").collect()):
            facts[r["column"]].top.append((r["value"], r["n"]))
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if texts:
            for r in (values.where(F.col("column").isin(texts)).groupBy("column").agg(
                    F.count_distinct(strip(F.col("value"))).alias("s"),
                    F.count_distinct(collapsed(F.col("value"))).alias("c")).collect()):
                facts[r["column"]].stripped_distinct = r["s"]
                facts[r["column"]].collapsed_distinct = r["c"]
    finally:
        values.unpersist()
    return facts


def _numbered(items: Column) -> Column:
    """Each item with how often it came before, so that equal sets mean equal multisets."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit("\u0000"), F.size(
        F.filter(F.slice(items, F.lit(1), i), lambda y: y == x)).cast("string")))


def _least_matched(both: int) -> int:
    """The fewest characters that match in labels of ``both`` characters at the least ratio."""
    return -(-2 * both // 5)


def _deletions(size: int) -> set[int]:
    """How many characters a short label loses where it meets a partner, for all partners' sizes."""
    partners = range(max(MIN_LABEL_CHARS, size - MAX_LENGTH_GAP),
                     min(size + MAX_LENGTH_GAP, SHORT_PAIR - size) + 1)
    return {size - _least_matched(size + n) for n in partners if _least_matched(size + n) <= min(size, n)}


def _short_pairs(labels: DataFrame) -> DataFrame:
    """``column, label, other``: pairs of together ``SHORT_PAIR`` characters or fewer that can be similar.

    The matching characters are a common subsequence, so each pair meets under one that is as long
    as its ratio asks for: what is left of either label when so many characters are deleted.
    """
    sizes = {n: _deletions(n) for n in range(MIN_LABEL_CHARS, SHORT_PAIR)}
    sizes = {n: d for n, d in sizes.items() if d}
    none = F.array().cast("array<string>")
    left = labels.where(F.col("size").isin(list(sizes))).withColumn("d0", F.array("label"))
    for d in range(1, max(map(max, sizes.values())) + 1):
        shorter = F.flatten(F.transform(f"d{d - 1}", lambda x: F.transform(
            F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(
                F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))))
        needed = [n for n, found in sizes.items() if max(found) >= d]
        left = left.withColumn(f"d{d}", F.when(F.col("size").isin(needed), F.array_distinct(shorter)).otherwise(none))
    levels = [F.when(F.col("size").isin([n for n, found in sizes.items() if d in found]), F.col(f"d{d}"))
              .otherwise(none) for d in range(max(map(max, sizes.values())) + 1)]
    keys = left.select("column", "label", "size", F.explode(F.concat(*levels)).alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    both = F.col("a.size") + F.col("b.size")
    return a.join(b, (F.col("a.column") == F.col("b.column")) & (F.col("a.key") == F.col("b.key"))
                  & (F.col("a.label") < F.col("b.label")) & (both <= SHORT_PAIR)
                  & (F.abs(F.col("a.size") - F.col("b.size")) <= MAX_LENGTH_GAP)
                  & (F.length("a.key") == F.ceil(2 * both / 5))).select(
        F.col("a.column").alias("column"), F.col("a.label").alias("label"), F.col("b.label").alias("other")).distinct()


def _long_pairs(labels: DataFrame) -> DataFrame:
    """``column, label, other``: the longer pairs that can be similar.

    Each gap between matching blocks holds an unmatched character, so at least ``(s - 1) / 5`` pairs of
    neighbouring characters lie in blocks, never none, at places that differ by no more than the characters
    that do not match. The rarest of them is among the rarest of each label (prefix filter).
    """
    known = labels.where(F.col("size") >= (SHORT_PAIR - MAX_LENGTH_GAP + 1) // 2)
    grams = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.substring("label", i, F.lit(2)))
    each = known.select("column", "label", "size", F.posexplode(grams).alias("at", "gram"))
    counts = each.groupBy("column", "gram").agg(F.count(F.lit(1)).alias("n"))
    # the fewest shared neighbours that a partner can have is with the shortest one
    shortest = F.greatest(F.col("size") - MAX_LENGTH_GAP, F.lit(MIN_LABEL_CHARS))
    fewest = F.greatest(F.lit(1), F.floor((F.col("size") + shortest - 1) / 5)).cast("int")
    def parts(width: int) -> Column:
        return _numbered(F.transform(F.sequence(F.lit(1), F.col("size") - (width - 1)),
                                     lambda i: F.substring("label", i, F.lit(width))))
    rare = cut_lineage(
        each.join(counts, ["column", "gram"]).groupBy("column", "label", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "gram", "at"))).alias("g"))
        .select("column", "label", "size", parts(1).alias("one"), parts(2).alias("two"),
                F.explode(F.slice("g", F.lit(1), F.col("size") - fewest)).alias("g"))
        .select("column", "label", "size", "one", "two", "g.gram", "g.at", "g.n"))
    # few neighbours are rare in many labels: pieces of one side meet the whole other, in tasks of their own
    pieces, key = F.ceil(F.col("n") / PIECE).cast("int"), ["column", "gram", "piece"]
    tasks = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = rare.withColumn("piece", F.pmod(F.xxhash64("label"), pieces).cast("int")).repartition(tasks, *key).alias("a")
    b = rare.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).repartition(tasks, *key).alias("b")
    both = F.col("a.size") + F.col("b.size")

    def shared(width: str) -> Column:
        return F.size(F.array_intersect(f"a.{width}", f"b.{width}"))
    return a.join(b, (F.col("a.column") == F.col("b.column")) & (F.col("a.gram") == F.col("b.gram"))
                  & (F.col("a.piece") == F.col("b.piece"))
                  & (F.col("a.label") < F.col("b.label")) & (both > SHORT_PAIR)
                  & (F.abs(F.col("a.size") - F.col("b.size")) <= MAX_LENGTH_GAP)
                  & (F.abs(F.col("a.at") - F.col("b.at"))
                     <= F.greatest("a.size", "b.size") - F.ceil(2 * both / 5))
                  & (5 * shared("one") >= 2 * both)
                  & (shared("two") >= F.greatest(F.lit(1), F.floor((both - 1) / 5)))).select(
        F.col("a.column").alias("column"), F.col("a.label").alias("label"), F.col("b.label").alias("other")).distinct()


def similar_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of labels that look like typing variants of each other, all of a column's labels compared.

    Labels of at least four characters whose lengths are close, at a matching-blocks ratio of 0.8: of
    two lengths that sum to ``s``, at least ``2 s / 5`` characters match. Short pairs meet under what such
    deletions leave of them, long ones under rare neighbouring characters; only labels travel.
    """
    labels = cut_lineage(
        long_form(df, columns, "string").where("value IS NOT NULL")
        .select("column", collapsed(F.col("value")).alias("label")).distinct()
        .withColumn("size", F.length("label")).where(F.col("size") >= MIN_LABEL_CHARS))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # much work per pair: keep the tasks that adaptive execution would merge
    return (_short_pairs(labels).unionByName(_long_pairs(labels)).repartition(tasks)
            .select("*", similarity("label", "other").alias("ratio")).where(F.col("ratio") >= MIN_RATIO))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row in every column."""
    return duplicate_count(df)


def stored_order(df: DataFrame) -> DataFrame | None:
    """The table with its file and the row's place in it, where the source has them."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias("block_"),
                         F.col("_metadata.row_index").alias("place_"))
    except AnalysisException:
        return None


def ordered_by(df: DataFrame, column: str) -> DataFrame:
    """The table with a whole-number column as its order, cut into blocks of places."""
    place = F.col(f"`{column}`").cast("long")
    return df.select("*", F.floor(place / ORDER_BLOCK).alias("block_"), place.alias("place_"))


def backward_steps(ordered: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose date is earlier than that of the row before them: ``column``, ``steps``.

    Blocks are walked in parallel; only each block's first and last date meet.
    """
    stamps = ordered.select("block_", "place_", *[
        parsed(F.col(f"`{c}`"), ordered.schema[c].dataType).alias(c) for c in columns])
    rows = long_form(stamps, columns, "timestamp", ["block_", "place_"]).where("value IS NOT NULL")
    walk = Window.partitionBy("column", "block_").orderBy("place_")
    blocks = (rows.withColumn("before", F.lag("value").over(walk)).groupBy("column", "block_")
              .agg(F.count_if(F.col("value") < F.col("before")).alias("steps"),
                   F.min_by("value", "place_").alias("first"),
                   F.max_by("value", "place_").alias("last")))
    across = Window.partitionBy("column").orderBy("block_")
    return (blocks.withColumn("steps", F.col("steps") + F.coalesce(
        (F.col("first") < F.lag("last").over(across)).cast("int"), F.lit(0)))
        .groupBy("column").agg(F.sum("steps").alias("steps")))


# --- the profile -------------------------------------------------------------

ISSUE = "issue string, severity string, detail string, affected_rows long, method string"
PROFILE_SCHEMA = (
    "position int, `column` string, raw_type string, inferred_type string, semantic_label string, "
    "null_count long, null_percentage double, unique_count long, stats map<string,double>, "
    "range struct<min:string,max:string>, top_values array<struct<value:string,count:long>>, "
    f"issues array<struct<{ISSUE.replace(' string', ':string').replace(' long', ':long')}>>, "
    "sensitive boolean")
ISSUE_SCHEMA = f"`column` string, {ISSUE}"


def _issue(name: str, severity: str, detail: str, rows: int, method: str | None = None) -> dict:
    return {"issue": name, "severity": severity, "detail": detail, "affected_rows": int(rows),
            "method": method}


def column_issues(f: ColumnFacts, outliers: dict, pairs: dict, steps: dict) -> list[dict]:
    """The quality rules of one column, applied to its facts."""
    issues, m, kind = [], f.measured, f.inferred
    if f.missing:
        pct = f.missing / f.rows * 100
        issues.append(_issue("missing_values", "high" if pct > 40 else "medium" if pct > 10 else "low",
                             f"{pct:.1f}% of values are missing", f.missing))
    if f.present and f.distinct == 1:
        issues.append(_issue("constant_column", "low", "all present values are equal", f.present))
    if kind == "numeric" and f.present > 4:
        o = outliers.get(f.name)
        if o and o["outliers"]:
            share = o["outliers"] / f.present
            issues.append(_issue("outliers", "medium" if share > 0.05 else "low",
                                 f"{o['outliers']} values outside 1.5*IQR", o["outliers"], "iqr"))
        if o and o["extreme_outliers"]:
            share = o["extreme_outliers"] / f.present
            issues.append(_issue(
                "extreme_outliers", "medium" if share > 0.02 else "low",
                f"{o['extreme_outliers']} values with a robust z-score above 3.5 "
                f"(median {o['median']:.4g}, scale {o['scale']:.4g})",
                o["extreme_outliers"], "robust_zscore"))
        if hinted(f.name, AMOUNT_HINTS) and m["negative"]:
            issues.append(_issue("invalid_range", "high",
                                 f"{m['negative']} negative amounts", m["negative"]))
    if kind == "categorical" and f.collapsed_distinct and f.collapsed_distinct < f.distinct:
        issues.append(_issue("inconsistent_categories", "medium",
                             f"{f.distinct} labels are {f.collapsed_distinct} apart from case "
                             "and spacing", f.present))
    if kind == "categorical" and pairs.get(f.name):
        shown = "; ".join(f"'{a}' ~ '{b}'" for a, b in pairs[f.name][:5])
        issues.append(_issue("similar_categories", "low",
                             f"{len(pairs[f.name])} label pair(s) may be variants: {shown}. "
                             "They are not merged.", f.present))
    if kind in ("categorical", "text") and len(m.get("units") or []) > 1:
        issues.append(_issue("inconsistent_units", "high",
                             f"more than one unit: {', '.join(m['units'])}", f.present))
    if kind == "datetime" and f.present:
        bad = f.present - m["dates"]
        if bad:
            issues.append(_issue("date_problems", "high", f"{bad} values are not dates", bad))
        odd = m["future"] + m["ancient"]
        if odd:
            issues.append(_issue("implausible_dates", "medium",
                                 f"{m['future']} far in the future, {m['ancient']} before 1900", odd))
        offsets, naive = m["offsets"], m["with_offset"] < f.present
        if m["dates"] and (len(offsets) > 1 or (offsets and naive)):
            issues.append(_issue("timezone_inconsistency", "high",
                                 "time zone offsets are mixed: " + ", ".join(offsets)
                                 + (" and none" if naive else ""), f.present))
        if m["dates"] > 2 and steps.get(f.name):
            issues.append(_issue("date_ordering", "low",
                                 f"{steps[f.name]} row(s) go back in time", steps[f.name]))
    return issues


def health_score(issues: list[dict]) -> int:
    return max(0, 100 - sum(SEVERITY_PENALTY.get(i["severity"], 2) for i in issues))


@dataclass
class Profile:
    """A table's description. Its size depends on the schema, not on the rows."""

    row_count: int
    columns: list[dict]
    dataset_issues: list[dict]

    @property
    def issues(self) -> list[dict]:
        return self.dataset_issues + [{"column": c["column"], **i}
                                      for c in self.columns for i in c["issues"]]

    @property
    def health(self) -> int:
        return health_score(self.issues)

    @property
    def issue_counts(self) -> dict[str, int]:
        return {s: sum(i["severity"] == s for i in self.issues) for s in ("high", "medium", "low")}

    def of_type(self, inferred: str) -> list[str]:
        return [c["column"] for c in self.columns if c["inferred_type"] == inferred]

    def pairs(self) -> set[tuple[str, str]]:
        return {(i.get("column") or "__dataset__", i["issue"]) for i in self.issues}

    def columns_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.columns, PROFILE_SCHEMA)

    def issues_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.issues, ISSUE_SCHEMA)


def profile(df: DataFrame, now: dt.datetime | None = None, sensitive: list[str] = (),
            order_by: str | None = None, anomalies: bool = True) -> Profile:
    """Profile every column and the table as a whole.

    Columns named ``sensitive`` keep their counts and ranges but show no values.
    ``order_by`` names a whole-number column holding the stored order; without it the
    position inside the source files is used where the reader offers one.
    """
    facts = column_facts(df, now)
    rows = next(iter(facts.values())).rows if facts else 0
    numeric = [c for c, f in facts.items() if f.inferred == "numeric"]
    outliers = {r["column"]: r for r in outlier_counts(df, numeric).collect()} if numeric else {}
    categories = [c for c, f in facts.items()
                  if f.inferred == "categorical" and isinstance(f.dtype, T.StringType)]
    pairs: dict[str, list] = {}
    if categories:
        for r in similar_labels(df, categories).orderBy("column", "label", "other").collect():
            pairs.setdefault(r["column"], []).append((r["label"], r["other"]))
    dates = [c for c, f in facts.items() if f.inferred == "datetime"]
    ordered = ordered_by(df, order_by) if order_by else stored_order(df)
    steps = ({r["column"]: r["steps"] for r in backward_steps(ordered, dates).collect()}
             if dates and ordered is not None else {})
    columns = []
    for i, f in enumerate(facts.values()):
        m, kind, secret = f.measured, f.inferred, f.name in set(sensitive)
        stats = {"count": float(f.present)}
        span = None
        if kind == "numeric" and f.present:
            o = outliers[f.name]
            stats |= {"min": m["min"], "max": m["max"], "mean": m["mean"],
                      "std": m["std"] if m["std"] is not None else 0.0,
                      "q1": o["q1"], "median": o["median"], "q3": o["q3"]}
        if kind == "datetime" and m.get("dates"):
            span = {"min": m["first"], "max": m["last"]}
        top = None if secret or kind in ("numeric", "datetime") else [
            {"value": v, "count": n} for v, n in f.top]
        columns.append({
            "position": i, "column": f.name, "raw_type": f.dtype.simpleString(),
            "inferred_type": kind, "semantic_label": semantic_label(f.name, kind),
            "null_count": f.missing,
            "null_percentage": round(f.missing / rows * 100, 2) if rows else 0.0,
            "unique_count": f.distinct, "stats": stats, "range": span, "top_values": top,
            "issues": column_issues(f, outliers, pairs, steps), "sensitive": secret})
    table = []
    repeats = duplicate_rows(df).first()["duplicate_rows"] if facts else 0
    if repeats:
        table.append({"column": None} | _issue(
            "duplicate_rows", "high" if repeats / rows > 0.05 else "medium",
            f"{repeats} exact copies of other rows", repeats))
    stored_numbers = [c for c, f in facts.items() if is_numeric(f.dtype)]
    if anomalies and len(stored_numbers) >= 2 and rows >= 50:
        odd = anomalous_rows(df, stored_numbers)
        if odd:
            table.append({"column": None} | _issue(
                "anomalous_rows", "low",
                f"{odd} row(s) are unusual across {len(stored_numbers)} numeric columns together",
                odd, "isolation_forest"))
    for f in facts.values():
        named = hinted(f.name, ID_HINTS) and f.present and f.distinct / f.present > 0.3
        repeated = f.present - f.distinct
        if f.present >= 2 and repeated and (named or f.inferred == "id"):
            shown = [] if f.name in set(sensitive) else [v for v, n in f.top[:3] if n > 1]
            table.append({"column": f.name} | _issue(
                "duplicate_keys", "high",
                f"{repeated} repeated value(s) across {f.repeated_keys} key(s), e.g. {shown}", repeated))
    return Profile(rows, columns, table)


def issue_summary(columns: DataFrame) -> DataFrame:
    """Issues per severity, the penalty and the health score, from a profile table."""
    issues = columns.select(F.explode("issues").alias("i")).select("i.*")
    points = F.when(F.col("severity") == "high", 12).when(F.col("severity") == "medium", 5).otherwise(2)
    return issues.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
        F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum(points), F.lit(0))).alias("health_score"))


def dashboard(columns: DataFrame) -> DataFrame:
    """All issues, the most severe first."""
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return (columns.select("column", F.explode("issues").alias("i")).select("column", "i.*")
            .orderBy(order, "column", "issue"))


def describe_types(columns: DataFrame) -> DataFrame:
    """Column names by inferred type, with each type's issue total."""
    return (columns.groupBy("inferred_type").agg(
        F.sort_array(F.collect_list("column")).alias("columns"),
        F.sum(F.size("issues")).alias("issues")).orderBy("inferred_type"))
