"""A training-text pipeline of five stages; each works on what the stage before it kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and gives the documents that go on. The first four
keep the columns of ``documents`` (and any others), the last gives ids and decoded text. Null texts and ids pass all stages; of
repeated rows with an id and words one stays, and of an id's several texts the smallest; a tie at a threshold is decided as in the
stage's operator; an empty table stays empty; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, common, contamination, neardup, secrets, toxicity
from sievework.sources.shipping import ship_package
from sievework.sources.staging import release_staged, staged_so_far


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    ship_package(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(~toxicity.flagged(docs, model))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    ship_package(spark)
    return neardup.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    ship_package(spark)
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars, if there is such a column, counts the new text."""
    ship_package(spark)
    found = secrets.masked(docs, bpe.public_vocabulary())
    if "n_chars" not in docs.columns:
        return found.select(docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from the ids."""
    ship_package(spark)
    return bpe.decoded_documents(docs, bpe.public_vocabulary()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("encoding", encoding_stage),
]

#: SQL can't express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage gives is written to the shared folder and read again, and the tables it made for itself go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = staged_so_far()
    for _, stage in STAGES:
        mark = staged_so_far()
        docs = common.staged(stage(spark, docs, sf_dir))
        release_staged(mark, keep=1)
        release_staged(before, keep=1)  # what the stage before gave has been read
    return docs
