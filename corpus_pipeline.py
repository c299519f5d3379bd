"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all but the last
return the columns of ``documents``, with ``n_chars`` brought up to date where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from cairnlake.llm.shared import checkpoint, read

#: Ids that are broadcast, at most; more are joined by a shuffle.
SMALL_IDS = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees keep."""
    model = quality_rules.train(docs, read(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; one that has nothing visible left goes."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    left = line_dedup.dedup_lines(whole).where((F.col("removed_chunks") == 0) | F.col("text").rlike(r"[^ \t\n\r]"))
    n_chars = F.when(F.col("removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return left.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of alike ones."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    A row is known by its doc_id and text, so rows without doc_id, or that share one, are each judged by themselves.
    """
    key = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256))
    ids = checkpoint(decontaminate.find(docs.select(key.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found")).distinct())
    # The columns travel as one, so that none can clash with the names used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    left = rows.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, F.col("key") == F.col("found"), "left_anti")
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and the sequence and place of each."""
    parts = checkpoint(packing.pieces(docs, packing.tokenizer_path()))
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: SQL has no way to fit trees, draw MinHashes or tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in order."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
