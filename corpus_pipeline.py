"""The corpus pipeline: language ID, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all of its predecessor's rows and returns a frame that is
written as Parquet and read again for the next; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import langid, packing, secret_scan, simhash, toxicity
from lexloom.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction below this score is no language that was learned.
LEAST_LANGUAGE_SCORE = 0.3

#: The models and the fingerprints of the stages cannot be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without letters, or unlike every language, go."""
    model = spark.sparkContext.broadcast(langid.learn(docs, F.lit(True)))
    found = langid.predict_column(model)(F.col("text"))
    return docs.withColumn("_language", found).where((F.col("_language.lang_pred") != langid.UND) & (F.col("_language.score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay."""
    model = spark.sparkContext.broadcast(toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(True)))
    return docs.withColumn("_toxic", toxicity.score_column(model)(F.coalesce("text", F.lit("")))).where("_toxic < 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a similarity of 0.8 or more one row of each group stays, one of the smallest id; rows without an id take part and stay if their group has no other.  Rows are told apart by id and text."""
    kept = simhash.representatives(docs.select("doc_id", "text"))
    rows = docs.withColumn("_row", simhash.row_key()).join(kept.withColumnRenamed("row", "_row"), "_row")
    # Rows of the same id and text: the first in the order of all columns, whatever the run.
    return rows.groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("_first")).select("_first.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by a mark, n_chars follows."""
    network = spark.sparkContext.broadcast(secret_scan.trained())
    clean = docs.withColumn("text", secret_scan.redact_column(network)(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
