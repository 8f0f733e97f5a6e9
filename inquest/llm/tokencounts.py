"""Token counts as rollups that change by signed deltas.

A batch of changes adds one set of signed entries, tokens and documents by source, language and
tokenizer version, and their sums; totals are the sums over all committed batches. An insert
adds, a delete takes back all that the ledger holds for the document, a revision does both. A
batch is written under its own name and counts only once its commit record exists: a batch that
was cut off is written anew, one that is committed already is left as it is, so sending it
again changes nothing.

Defined results: rows that repeat an id in a batch each count. A delete of an unknown
document changes nothing. Null ids are an id of their own; null sources and languages are
groups of their own; a null text has no tokens. Groups without documents are not
reported. An empty batch commits without entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inquest.llm.common import WORD

KEY = ["source", "lang", "version"]
ENTRY = "doc_id long, source string, lang string, version string, docs long, tokens long"
# What each tokenizer version counts.
TOKENIZERS = {"words-1": WORD, "pieces-1": r"[A-Za-z0-9]+|[^\x00-\x20A-Za-z0-9]"}


def counted(docs: DataFrame, text: Column, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, source, lang, version, tokens``: each text counted by each tokenizer."""
    counts = [F.struct(F.lit(v).alias("version"), F.coalesce(
        F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long").alias("tokens"))
        for v, p in sorted((tokenizers or TOKENIZERS).items())]
    return docs.select("doc_id", "source", "lang", F.explode(F.array(*counts)).alias("c")).select(
        "doc_id", "source", "lang", "c.version", "c.tokens")


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self) -> list[str]:
        """Names of the batches that count, in no order."""
        home = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(home):
            return []
        found = [s.getPath() for s in files.listStatus(home)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.getName() for p in found if files.exists(done(p, "_SUCCESS")))

    def read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{name}" for name in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def apply(self, batch: str, inserts: DataFrame | None = None,
              deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Commit a batch; False if it was committed before.

        ``inserts`` and ``revisions`` are rows of ``counted``; ``deletes`` has ``doc_id``.
        """
        if batch in self.committed():
            return False
        entries = self.spark.createDataFrame([], ENTRY)
        for rows in (inserts, revisions):
            if rows is not None:
                entries = entries.unionByName(rows.select(
                    "doc_id", *KEY, F.lit(1).cast("long").alias("docs"), "tokens"))
        gone = None
        for rows in (deletes, revisions):
            if rows is not None:
                ids = rows.select(F.col("doc_id").alias("gone_id"))
                gone = ids if gone is None else gone.unionByName(ids)
        if gone is not None:
            ledger = self.read("ledger", ENTRY)
            held = ledger.join(gone.distinct(), F.col("doc_id").eqNullSafe(F.col("gone_id")),
                               "left_semi").groupBy("doc_id", *KEY).agg(
                F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            entries = entries.unionByName(held.select(
                "doc_id", *KEY, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        entries.write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        entries = self.spark.read.schema(ENTRY).parquet(f"{self.path}/ledger/{batch}")
        sums = entries.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/{batch}")
        self.spark.createDataFrame([(batch,)], "batch string").write.mode("overwrite").parquet(
            f"{self.path}/commits/{batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens`` over all committed batches."""
        sums = self.read("sums", ", ".join(ENTRY.split(", ")[1:]))
        return sums.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")
                                      ).filter("docs <> 0")
