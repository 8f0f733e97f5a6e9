"""Chunking, hashed word vectors, and similarity search over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inquest.constants import (CHUNK_OVERLAP, CHUNK_SIZE, EMBEDDING_DIM, EMBEDDING_SIGNATURE,
                               MIN_ANSWER_SCORE, MIN_DEFINITION_SCORE)
from inquest.functions.strings import strip
from inquest.functions.tables import spread
from inquest.functions.vectors import cosine_to, text_vector, token_buckets, unit_vector

CONTEXT_TYPES = ["business_doc", "web_page"]


def chunks_of(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Paragraphs packed up to ``size`` characters; a longer one is cut with an overlap."""
    none = F.array().cast("array<string>")
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")

    def cut(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1)), F.lit(size - overlap))
        return F.filter(F.transform(starts, lambda i: strip(p.substr(i, F.lit(size)))),
                        lambda c: c != "")

    def one(c: Column) -> Column:
        return F.when(c != "", F.array(c)).otherwise(none)

    def pack(state: Column, p: Column) -> Column:
        held = state["held"]
        fits = F.length(held) + F.length(p) + 2 <= size
        short = F.length(p) <= size
        joined = F.when(held != "", F.concat(held, F.lit("\n\n"), p)).otherwise(p)
        return F.struct(
            F.when(fits, joined).when(short, p).otherwise("").alias("held"),
            F.when(fits, state["done"]).otherwise(
                F.concat(state["done"], one(held), F.when(short, none).otherwise(cut(p)))).alias("done"))

    start = F.struct(F.lit("").alias("held"), none.alias("done"))
    return F.aggregate(paragraphs, start, pack, lambda s: F.concat(s["done"], one(s["held"])))


def chunk_documents(docs: DataFrame, document_id: str = "document_id", text: str = "text",
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk with its place in the document; the whole text is chunked."""
    others = [c for c in docs.columns if c != text]
    return (docs.where(F.col(text).isNotNull())
            .select(*others, F.posexplode(chunks_of(F.col(text), size, overlap))
                    .alias("chunk_index", "content"))
            .withColumn("chunk_id", F.concat_ws(":", F.col(document_id).cast("string"), "chunk_index")))


def embed(chunks: DataFrame, text: str = "content") -> DataFrame:
    """``vector``, its ``norm``, the word count and the model signature."""
    return (spread(chunks).withColumn("unit_", unit_vector(F.col(text)))
            .withColumn("vector", F.col("unit_.vector"))
            .withColumn("norm", F.when(F.col("unit_.tokens") > 0, 1.0).otherwise(0.0))
            .withColumn("token_count", F.col("unit_.tokens"))
            .withColumn("embedding", F.lit(EMBEDDING_SIGNATURE)).drop("unit_"))


def bucket_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same vectors in sparse form: ``key``, ``bucket`` and the unit ``weight``."""
    tokens = spread(docs.select(key, text)).select(
        key, F.explode(token_buckets(F.col(text))).alias("bucket"))
    counts = tokens.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / length).alias("weight"))


def index_documents(docs: DataFrame, document_id: str = "document_id") -> DataFrame:
    """Documents to searchable chunks."""
    return embed(chunk_documents(docs, document_id))


def stored_documents(docs: DataFrame) -> DataFrame:
    """The document rows kept beside the chunks, with their whole text."""
    subject = F.nullif(F.substring(strip(F.col("subject")), 1, 120), F.lit(""))
    return (docs.withColumn("subject", subject).withColumn("status", F.lit("embedded")))


def scope_of(subject: Column, url: Column, document_type: Column) -> Column:
    """The body of knowledge a document belongs to: subject, else site, else kind."""
    cleaned = strip(F.coalesce(subject, F.lit("")))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1)), r"^www\.", "")
    return (F.when(cleaned != "", F.concat(F.lit("subject:"), F.lower(cleaned)))
            .when(url.startswith("http"), F.concat(F.lit("site:"), host))
            .when(document_type == "past_report", "reports").otherwise("uploads"))


def list_scopes(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks per scope, the largest first."""
    scoped = docs.select("document_id", scope_of(F.col("subject"), F.col("url"), F.col("document_type"))
                         .alias("scope"))
    per = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return (scoped.join(per, "document_id", "left").groupBy("scope")
            .agg(F.count(F.lit(1)).alias("documents"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
            .orderBy(F.desc("chunks"), "scope"))


def set_subject(docs: DataFrame, document_ids: list, subject: str | None) -> DataFrame:
    """Another label for some documents; texts and vectors stay as they are."""
    cleaned = (subject or "").strip()[:120] or None
    return docs.withColumn("subject", F.when(F.col("document_id").isin(document_ids), F.lit(cleaned))
                           .otherwise(F.col("subject")))


def _candidates(chunks: DataFrame, document_type=None, owner=None, scope=None) -> DataFrame:
    """Structured filters come before any score, and vectors of another length are left out."""
    if isinstance(document_type, (list, tuple, set)):
        chunks = chunks.where(F.col("document_type").isin(list(document_type)))
    elif document_type:
        chunks = chunks.where(F.col("document_type") == document_type)
    if owner is not None:
        chunks = chunks.where(F.col("owner_id") == owner)
    if scope:
        chunks = chunks.where(scope_of(F.col("subject"), F.col("url"), F.col("document_type")) == scope)
    return chunks.where(F.size("vector") == EMBEDDING_DIM)


def search(chunks: DataFrame, query: str, top_k: int = 5, document_type=None,
           min_score: float = 0.0, owner=None, scope: str | None = None) -> DataFrame:
    """The chunks most similar to a text. A narrow scan and a top-k; nothing is shuffled."""
    raw = cosine_to(F.col("vector"), text_vector(query), F.col("norm"))
    return (_candidates(chunks, document_type, owner, scope).where(raw >= min_score)
            .withColumn("score", F.round(raw, 4)).drop("vector", "norm")
            .orderBy(F.desc("score"), "chunk_id").limit(top_k))


def score_many(chunks: DataFrame, queries: dict[str, str], document_type=None,
               min_score: float = 0.0, owner=None, scope: str | None = None) -> DataFrame:
    """Every chunk that reaches ``min_score`` for a query; all queries in one scan."""
    scores = F.array(*[F.struct(
        F.lit(name).alias("query_id"),
        cosine_to(F.col("vector"), text_vector(text), F.col("norm")).alias("raw"))
        for name, text in queries.items()])
    rows = (_candidates(chunks, document_type, owner, scope)
            .withColumn("s_", F.explode(F.filter(scores, lambda s: s["raw"] >= min_score)))
            .drop("vector", "norm"))
    return (rows.withColumn("query_id", F.col("s_.query_id"))
            .withColumn("score", F.round("s_.raw", 4)).drop("s_"))


def search_many(chunks: DataFrame, queries: dict[str, str], top_k: int = 5, document_type=None,
                min_score: float = 0.0, owner=None, scope: str | None = None) -> DataFrame:
    """Top-k chunks for each of a few texts."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (score_many(chunks, queries, document_type, min_score, owner, scope)
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k))


def nearest(vectors: DataFrame, query: list[float], key: str, column: str = "embedding",
            top_k: int = 5) -> DataFrame:
    """The rows whose stored vectors point most nearly the same way as ``query``."""
    score = F.round(cosine_to(F.col(column), [float(x) for x in query]), 4)
    return (vectors.where(F.size(column) == len(query)).select(key, score.alias("score"))
            .orderBy(F.desc("score"), key).limit(top_k))


def definitions(chunks: DataFrame, terms: list[str], owner=None) -> DataFrame:
    """One definition per term: from the KPI definitions, else from the data dictionary."""
    unique = {t.lower(): t for t in reversed(terms)}
    if not unique:
        return chunks.sparkSession.createDataFrame(
            [], "term string, definition string, source string, score double")
    hits = score_many(chunks, {t: t for t in unique.values()},
                      ["kpi_definition", "data_dictionary"], MIN_DEFINITION_SCORE, owner)
    tier = F.when(F.col("document_type") == "kpi_definition", 0).otherwise(1)
    first = Window.partitionBy("query_id").orderBy(tier, F.desc("score"), "chunk_id")
    return (hits.withColumn("k_", F.row_number().over(first)).where("k_ = 1")
            .select(F.col("query_id").alias("term"), F.col("content").alias("definition"),
                    F.col("title").alias("source"), "score"))


def plan_terms(question: str, columns: list[str]) -> list[str]:
    """Up to six longer words of the question and eight column names."""
    named = [w.strip(" ?.,") for w in question.split() if len(w) > 4]
    return named[:6] + list(columns)[:8]


def plan_context(chunks: DataFrame, question: str, columns: list[str],
                 owner=None) -> tuple[DataFrame, DataFrame]:
    """Definitions and three background passages for planning an investigation."""
    return (definitions(chunks, plan_terms(question, columns), owner),
            search(chunks, question, 3, CONTEXT_TYPES, owner=owner))


def passages(chunks: DataFrame, question: str, top_k: int = 6, owner=None,
             scope: str | None = None) -> DataFrame:
    """Numbered passages for a question, and whether they come from unrelated sources."""
    hits = search(chunks, question, top_k, min_score=MIN_ANSWER_SCORE, owner=owner, scope=scope)
    order = Window.orderBy(F.desc("score"), "chunk_id")  # at most top_k rows
    found = hits.select(
        F.row_number().over(order).alias("n"), "title", "document_type", "score", "content",
        "chunk_id", "url", scope_of(F.col("subject"), F.col("url"), F.col("document_type")).alias("scope"))
    bodies = F.array_sort(F.collect_set("scope").over(Window.partitionBy()))
    return (found.withColumn("scopes_used", bodies)
            .withColumn("mixed_sources", (F.size("scopes_used") > 1) & F.lit(scope is None))
            .withColumn("excerpt", F.substring("content", 1, 400)))


def brief_sections(found: DataFrame) -> DataFrame:
    """Passages grouped by the document they come from, at most eight sections."""
    parts = F.array_sort(F.collect_list(F.struct("n", F.substring("content", 1, 600).alias("text"))))
    return (found.groupBy(F.col("title").alias("heading")).agg(parts.alias("p"))
            .select("heading", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("body"),
                    F.transform("p", lambda x: x["n"]).alias("cites"))
            .orderBy(F.col("cites")[0]).limit(8))


def stale_report(chunks: DataFrame) -> DataFrame:
    """Chunks whose vectors belong to another model, per model."""
    return (chunks.where(_is_stale())
            .groupBy(F.coalesce("embedding", F.lit("unknown")).alias("embedding"))
            .agg(F.count(F.lit(1)).alias("chunks")).orderBy("embedding"))


def _is_stale() -> Column:
    return (~F.col("embedding").eqNullSafe(F.lit(EMBEDDING_SIGNATURE))
            | (F.coalesce(F.size("vector"), F.lit(-1)) != EMBEDDING_DIM))


def reembed(chunks: DataFrame) -> DataFrame:
    """New vectors for stale chunks only; ids and the other rows are unchanged."""
    keep = chunks.withColumn("stale_", _is_stale())
    columns = chunks.columns
    return (keep.where(~F.col("stale_")).select(*columns).unionByName(
        embed(keep.where(F.col("stale_")).drop("vector", "norm", "embedding", "token_count")).select(*columns)))


def index_health(chunks: DataFrame) -> DataFrame:
    """Chunks, characters and vector size per document, with a note on odd ones."""
    per = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("characters"),
        F.max(F.size("vector")).alias("dimensions"))
    return per.withColumn("note", F.when(F.col("characters") < 400, "very little text")
                          .when((F.col("dimensions") > 0) & (F.col("dimensions") != EMBEDDING_DIM),
                                "vector size differs"))


def report_document(reports: DataFrame) -> DataFrame:
    """Finished reports as documents, so that later questions find them.

    Needs ``id``, ``question``, ``target_metric``, ``executive_summary``, ``owner_id`` and the
    arrays ``findings`` (statement, evidence_summary) and ``actions``.
    """
    lines = F.concat(
        F.array(F.concat(F.lit("Question: "), F.col("question")),
                F.concat(F.lit("Target metric: "), F.coalesce("target_metric", F.lit("unspecified"))),
                F.coalesce("executive_summary", F.lit(""))),
        F.flatten(F.transform("findings", lambda f: F.array(
            F.concat(F.lit("Finding: "), F.coalesce(f["statement"], F.lit(""))),
            F.concat(F.lit("Evidence: "), F.coalesce(f["evidence_summary"], F.lit("")))))),
        F.transform("actions", lambda a: F.concat(F.lit("Recommendation: "), a)))
    return reports.select(
        F.concat(F.lit("report-"), "id").alias("document_id"),
        F.concat(F.lit("Investigation report: "), F.substring("question", 1, 120)).alias("title"),
        F.array_join(F.filter(lines, lambda t: t != ""), "\n").alias("text"),
        F.lit("past_report").alias("document_type"), "owner_id",
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("subject"),
        "investigation_id")


def related_history(chunks: DataFrame, question: str, own_id: str, owner=None) -> DataFrame:
    """The three most similar past reports, without the investigation's own."""
    hits = search(chunks, question, 3, "past_report", owner=owner)
    return hits.where(F.col("title").isNotNull() & (F.col("title") != "")
                      & ~F.col("investigation_id").eqNullSafe(F.lit(own_id)))
