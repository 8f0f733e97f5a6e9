"""The corpus pipeline: five stages, each from documents to documents, the last to token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from inquest.llm import bytepairs, lines, mixing, shinglesets, toxicity
from inquest.llm.common import broadcast_within, shared_folder, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, rejects go.

    Null and empty texts hold no toxic term and stay, repeated rows share a fate, a tie at the
    threshold counts as toxic, and an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted from the texts; every document stays.

    The copy in the document with the smallest id comes first; rows that repeat id and text count as
    one document and end alike. Null texts stay null, an empty table stays empty.
    """
    return lines.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: shingles of five words, Jaccard 0.8.

    SimHash fingerprints within 3 of 64 bits name the first pairs, the sets of shingles confirm them
    and add the pairs that fingerprints do not show.

    The smallest id stays, nulls last; of rows that share it the smallest by its columns. Null and empty
    texts are one class. An empty table stays empty.
    """
    return shinglesets.one_per_class(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is a source of its own. Rows that repeat id and text share a hash and are
    taken alike; texts without words have no size and are not taken. An empty table stays empty.
    """
    of, u, copies, v, nth = (unused(docs, n) for n in ("of", "u", "copies", "v", "nth"))
    mixed = mixing.mix(docs).filter("copies > 0").select(
        F.col("doc_id").alias(of), F.col("u").alias(u), F.col("copies").alias(copies))
    here = docs.select("*", mixing.place("doc_id", "text").alias(v))
    taken = here.join(broadcast_within(mixed.distinct(), 32), F.col("doc_id").eqNullSafe(F.col(of))
                      & (F.col(u) == F.col(v)))
    again = F.explode(F.sequence(F.lit(1), F.col(copies)))
    return taken.withColumn(nth, again).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to; null texts have none."""
    return bytepairs.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines),
          ("simhash_near_dedup", drop_near_copies), ("mix_sources", mix_sources),
          ("byte_bpe", encode)]

#: The stages use models, fingerprints and hashes that SQL lacks; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
