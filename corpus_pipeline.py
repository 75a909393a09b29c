"""Corpus pipeline: toxicity, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before has kept. All but the last return the columns of their input, extra ones
and clashing names included; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.llm.common import checkpointed, load
from quadspark.llm.decontaminate import find_contamination
from quadspark.llm.jaccard_join import jaccard_join
from quadspark.llm.packing import pack
from quadspark.llm.secret_scan import redact_secrets
from quadspark.llm.toxicity import fit, score_toxicity
from quadspark.session import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go. The examples come from the documents as they are here.

    Each row is judged by its text alone, so rows of equal text stay or go
    together, whatever their ids; a null text is an empty one; rows without an id
    are judged too.
    """
    ship(spark)
    index = fit(docs, load(spark, sf_dir, "labels"), F.lit(True))
    return score_toxicity(docs, index, output="_toxicity").where("_toxicity.predicted = 0").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document of least doc_id stays; so do texts without a word and null doc_ids.

    Rows of one doc_id stand or fall together; of rows with one doc_id and text the one stays whose other columns are least.
    """
    ship(spark)
    classes = jaccard_join(docs)
    gone = classes.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("first")).where("NOT first").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = checkpointed(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_least")
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(least)
    return once.unionByName(again.select("doc_id", "text", *(F.col(f"_least.`{c}`").alias(c) for c in others)).select(*docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: each row by its text alone; null and empty texts stay."""
    ship(spark)
    found = find_contamination(docs, load(spark, sf_dir, "benchmark"), output="_matches")
    return found.where(F.size("_matches") == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, repeated ones too; its secrets are replaced by their kinds and ``n_chars`` follows the text; a null text stays null."""
    ship(spark)
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in optimal length buckets and token-budget batches; rows without a word have no piece, repeated rows are packed each."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the ranking of neighbours nor the similarity join at this size; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the checkpoint folder for the next."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
