"""A training-corpus pipeline of five stages; each works on all that its predecessor kept.

Every stage but the last returns the columns of its documents, whatever others there are and whatever their names. An
empty table stays empty. Rows are told apart by nothing but their content: repeated rows and null ids are rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontamination, near_duplicates, packing, secrets, toxicity
from quern.llm.common import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the score of the bias alone; rows of equal texts go or stay together. Of an id's several
    labels the greatest counts. Without labels nothing is rejected.
    """
    model = toxicity.trained(toxicity.training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.without_toxic(docs, model)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one of the least id, null ids last; one of equal rows.

    Null and empty texts are one class.
    """
    return near_duplicates.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none, null and wordless items are nowhere."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strong secrets and linked parts are replaced by a mark, overlapping ones by one; documents stay. Null texts stay
    null, and ``n_chars``, where there is one, counts the new text."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences of 2048. Null and empty texts are one end token; equal lengths
    are told apart by their place in the input."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_copy),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express none of the trained, hashed and packed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
