"""From raw documents to a training mix: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, jaccard, line_dedup, mixing, toxicity
from skein.llm.shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents.

    Null and empty texts get the score of no words; where labels are missing or of one kind,
    every text gets their rate. Repeated rows each get their score.
    """
    return toxicity.reject(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks go from all texts but the first; so do documents of which nothing is left.

    Null texts and texts without a removed line stay as they are, empty ones too; n_chars follows the text.
    """
    own = {c: f"_own_{c}" for c in docs.columns if c in ("n_lines", "n_removed")}
    cleaned = line_dedup.dedup(spark, docs.withColumnsRenamed(own))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\r\n\t", "")) == "")
    kept = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; documents without words or doc_id all stay."""
    return jaccard.dedup(spark, docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that they cover for the most part; all others stay as they are."""
    return decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The cleaned documents, how many words the mix takes of each (0 of texts without words), and where its draws go."""
    return mixing.mix_documents(spark, docs)


#: Stages in order; each takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
