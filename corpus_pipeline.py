"""The corpus pipeline: each stage works on all that its predecessor kept; its result is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm import decontamination, jaccard, line_dedup, mixing, toxicity
from lumenweave.llm.common import made, mark, shared_dir, sweep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# A row of docs is a document: stages decide by its text, so rows without doc_id and rows that repeat one are judged like all others. Columns
# besides those of documents are left out by the first stage that meets them. An empty table stays empty in every stage.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity field rejects go.

    Null and empty texts score as texts without words, and stay. Texts of any length are scored whole. Without labels nothing is rejected.
    """
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and with them documents of which nothing is left; n_chars follows the text.

    Null and empty texts stay. Rows without doc_id stay as they are. Rows that repeat doc_id and text are one document here, and get the same result.
    """
    out = line_dedup.dedup(docs.select(*COLUMNS))
    left = F.coalesce(F.col("n_removed") == 0, F.lit(True)) | (F.trim("text") != "")
    return out.where(left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by similarity 0.8 or more on five-word shingles, the one with the least doc_id stays; a row without doc_id only if no other is linked.

    Of rows that have the same doc_id and text one stays. Null texts and texts without words are linked with nothing, and stay.
    """
    return jaccard.keep_one(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of any benchmark item go: eight words in a row, or a whole item of fewer.

    Null and empty texts, and texts of any length without such a passage, stay as they are.
    """
    return decontamination.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn at target weights, with their weight, probability and what their margins miss.

    Null sources and languages are values of their own. Texts without words are never drawn. Rows that repeat a doc_id are drawn together, and
    so are all without one that have the same probability.
    """
    drawn = mixing.mix(docs.select(*COLUMNS)).where("selected")
    return drawn.select(*COLUMNS, "n_tokens", "topic", "weight", "probability", "missed")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", draw_mixture),
]

#: Trained fields, fingerprints of sets and hashed draws are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = made(f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        since = mark()
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}")
        sweep(spark, since)  # what the stage wrote on its way is no longer needed
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
