"""Personal data: fixed patterns, and terms that give a protected value away.

Base spans come from four patterns. Each value they find is a protected entity, its contexts are
the lines that hold it. Corpus co-occurrence then estimates what a term discloses: of all lines
with the term, the share that holds one and the same entity, and how many bits seeing the term
adds about that entity (pointwise mutual information). A term over both thresholds, seen in
several different lines with the entity, is a span of kind ``term``: it is removed when nearly
all its lines hold the entity, and generalised otherwise.

Terms are runs of three letters or more, lower-cased. Only columns are used. The patterns have
possessive or anchored parts so that long runs take linear time; they match what the plain
patterns match.

Defined results: a null text is the empty text, without spans. Offsets count code points, ends
are exclusive. Rows with equal id and text get the same spans; copies of a line count once for
the number of different lines. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inquest.llm.common import broadcast_within, present, spool

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"
REMOVED = 0.95            # from this share of its lines on, a term is removed


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(
            p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", F.substring(digits, 1, 19))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def checked(kind: str) -> Column:
    return F.filter(kind, lambda s: valid(kind, s["value"]))


def placed(text: Column, pattern: Column, matches: Column) -> Column:
    """``start, end, value`` of each match, from the pieces between the matches."""
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(
        F.length(g).alias("gap"), m.alias("value")))
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + pair["gap"]
        last = first + F.length(pair["value"])
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(F.struct(
            first.alias("start"), last.alias("end"), pair["value"].alias("value")))).alias("out"))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds an array of spans for each kind; ``rows`` has ``text``."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = rows.select("*", *[F.when(
        F.contains(F.col("text"), F.lit("@")) if kind == "email" else F.col("text").rlike(NEEDS[kind]),
        F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).alias(f"m_{kind}")
        for kind in KINDS])
    spans = found.select(*rows.columns, *[F.when(
        F.size(f"m_{kind}") > 0, placed(F.col("text"), F.lit(PATTERNS[kind]), F.col(f"m_{kind}")))
        .otherwise(none).alias(kind) for kind in KINDS])
    return spans.select(*rows.columns, *[
        checked(kind).alias(kind) for kind in KINDS])


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def contexts(found: DataFrame) -> DataFrame:
    """``entity, line, terms``: a row for each protected value and the line around it."""
    def entity(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            F.concat(F.lit(kind + ":"), F.lower(s["value"])).alias("entity"),
            s["start"].alias("start"), s["end"].alias("end")))
    marked = found.select("text", F.explode(F.concat(*map(entity, KINDS))).alias("s"))
    left = F.substring_index(F.substring("text", F.lit(1), F.col("s.start")), "\n", -1)
    right = F.substring_index(F.substring("text", F.col("s.end") + 1, F.length("text")), "\n", 1)
    around = F.concat(left, F.lit(" "), right)
    return marked.select("s.entity", F.xxhash64(around).alias("line"),
                         F.array_distinct(terms(around)).alias("terms"))


def disclosing(docs: DataFrame, found: DataFrame, share: float, bits: float,
               lines: int) -> DataFrame:
    """``term, entity, share, bits``: terms whose lines give an entity away.

    ``docs`` has the whole corpus (``text``), ``found`` the documents with protected values.
    """
    seen = spool(contexts(found))
    pairs = (seen.select("entity", "line", F.explode("terms").alias("term"))
             .groupBy("term", "entity", "line").count()
             .groupBy("term", "entity").agg(F.sum("count").alias("both"),
                                            F.count("*").alias("lines")))
    pairs = spool(pairs.filter(F.col("lines") >= lines))
    per_entity = seen.groupBy("entity").agg(F.count("*").alias("with_entity"))
    wanted = spool(pairs.select("term").distinct())
    if wanted.isEmpty():
        return pairs.select("term", "entity", F.lit(0.0).alias("share"), F.lit(0.0).alias("bits"))
    # in how many lines of the corpus each wanted term occurs
    every = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(
        F.explode(F.array_distinct(terms(F.col("line")))).alias("term"))
    per_term = every.join(broadcast_within(wanted, 256), "term").groupBy("term").agg(
        F.count("*").alias("with_term"))
    total = docs.agg(F.sum(F.size(F.split("text", "\n"))).alias("n")).first()["n"]
    told = F.least(F.lit(1.0), F.col("both") / F.col("with_term"))
    gain = F.log2(told * F.lit(float(total)) / F.col("with_entity"))
    return (pairs.join(per_entity, "entity").join(per_term, "term")
            .select("term", "entity", told.alias("share"), gain.alias("bits"))
            .filter((F.col("share") >= share) & (F.col("bits") >= bits)))


def spans(docs: DataFrame, share: float = 0.8, bits: float = 3.0, lines: int = 3,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``, an array of spans for each kind, and ``term`` for what the corpus adds."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       present(F.col(text_col)).alias("text"))
    some = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])
    found = spool(base_spans(rows).filter(some))
    telling = spool(disclosing(rows, found, share, bits, lines).groupBy("term").agg(
        F.max("share").alias("share")))
    out = base_spans(rows)
    none = F.array().cast("array<struct<start:int,end:int,value:string,share:double>>")
    if telling.isEmpty():
        return out.withColumn("term", none)
    key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), F.xxhash64("text").alias("h")]
    hits = (rows.select(*key, F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
            .join(broadcast_within(telling, 256), "term"))
    hits = spool(hits.groupBy("o", "h").agg(F.collect_set(F.struct("term", "share")).alias("hits")))
    widest = hits.agg(F.max(F.size("hits"))).first()[0] or 0
    joined = out.select("*", *key).join(broadcast_within(hits, 48 + 64 * widest), ["o", "h"], "left")

    def where(hit: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})"), hit["term"], F.lit(r"(?!\p{L})"))
        at = placed(F.col("text"), pattern,
                    F.regexp_extract_all("text", pattern, F.lit(0)))
        return F.transform(at, lambda s: F.struct(s["start"], s["end"], s["value"],
                                                  hit["share"].alias("share")))
    added = F.when(F.col("hits").isNotNull(), F.flatten(F.transform("hits", where)))
    # what lies inside a base span is protected already
    base = F.concat(*[F.col(k) for k in KINDS])
    free = F.filter(F.coalesce(added, none), lambda t: ~F.exists(
        base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return joined.select("doc_id", "text", *KINDS, free.alias("term"))


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    def numbered(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))
    every = F.concat(*[numbered(i, k) for i, k in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of the rows of ``spans``."""
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(listed(KINDS), 256).alias("base_sha256"),
                        listed((*KINDS, "term")).alias("spans"))


def sanitised(found: DataFrame) -> DataFrame:
    """``doc_id, text`` with base spans named by their kind and disclosing terms withheld."""
    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind}]").alias("put")))
    cut = F.concat(*map(named, KINDS), F.transform("term", lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.when(s["share"] >= REMOVED, "").otherwise("[term]").alias("put"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        # spans of two kinds may overlap: the text up to the furthest end is withheld
        piece = F.substring(F.col("text"), state["at"] + 1,
                            F.greatest(F.lit(0), s["start"] - state["at"]))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.concat(state["out"], piece, s["put"]).alias("out"))
    text = F.aggregate(F.array_sort(cut), state, step, lambda s: F.concat(
        s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return found.select("doc_id", text.alias("text"))
