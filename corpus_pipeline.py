"""A training corpus from the documents table, in five stages.

toxic documents go; one document of each group of near-duplicates stays; documents with benchmark passages go;
personal data is replaced by its kind; what is left is packed into windows. Each stage takes (spark, docs, sf_dir) and
its result is written as Parquet and read again as the next one's docs. All but the last return the documents' columns.

Defined cases, of every stage: a null or empty text is clean, alike with none, and packed as the end id alone; nulls in other
columns are kept; very long texts are judged whole; of repeated rows one is left by the near-duplicate stage, and of
equal copies the one with the least id; rows of one id with unlike texts are judged each; an empty table gives no rows; extra
columns are carried over to the last stage, also those named like an operator's outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import decontamination, neardup, packing, pii, toxicity
from sparkwarden.llm.common import table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, by a model of the labelled ones among them."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.withColumn("_keep", F.struct(*docs.columns)), model).where(F.col("predicted") == 0).select("_keep.*")


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked by five-word shingles and a similarity of 0.8; of repeated rows one."""
    return neardup.deduplicated(docs, size=5, percent=80)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens, mixed by source."""
    pieces = packing.packed(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity_filter), ("near_duplicates", near_duplicate_filter), ("decontamination", decontamination_filter), ("pii", pii_redaction), ("packing", packed_windows)]

#: Training, sketches and tokens have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
