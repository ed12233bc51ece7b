"""The training-data pipeline over documents: toxicity, line and near deduplication, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import personal_data, toxicity
from tablewright.llm.line_duplicates import dedup_lines
from tablewright.llm.near_duplicates import near_duplicates
from tablewright.llm.packing import pack
from tablewright.llm.store import Stored, kept_tables, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; labels outside the held-out fifth are learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    model = toxicity.fit(texts, labels.where(~held_out).select(F.col("doc_id").alias("id"), "toxic"))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, of near-equal lines only the first left."""
    return _measured(dedup_lines(docs.select(*COLUMNS)))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; documents without words stay."""
    gone = near_duplicates(docs).where("not kept and component_id is not null").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    return rest


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return _measured(personal_data.mask(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

# Toxicity, near duplicates and packing can't be said in SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again.

    What a stage has kept on the way, and its input, is deleted once its output is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        others = kept_tables(spark)
        output = Stored(spark)
        docs = output.keep(stage(spark, docs, sf_dir), name)
        release(spark, {*(path for path in others if path not in before), *output.paths})
        before = output.paths
    return docs
