"""The pipeline's stages on their own inputs, and the registered queries."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__
from tablewright.llm import personal_data, toxicity
from tablewright.llm.line_duplicates import dedup_lines
from tablewright.llm.near_duplicates import near_duplicates
from tablewright.llm.packing import pack
from tablewright.llm.queries import QUERIES
from tablewright.llm.store import kept_tables, release


def test_registered():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(QUERIES) <= set(names)


def test_stages(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.dtypes
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tiny)
        assert name == "packing" or out.dtypes == columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = kept[name][1]
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = toxicity.fit(before.select(F.col("doc_id").alias("id"), "text"), labels.where(~held).select(F.col("doc_id").alias("id"), "toxic"))
    clean = {r.doc_id for r in toxicity.score(before.select("doc_id", "text"), model).where("score < 0.5").collect()}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = kept["line_dedup"]
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: r.text for r in dedup_lines(before.select("doc_id", "text")).collect()}
    before, after = kept["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in near_duplicates(before).collect() if r.kept}
    before, after = kept["personal_data"]
    assert before.count() == after.count() and personal_data.find(after).agg(F.sum("n_email") + F.sum("n_phone")).first()[0] == 0
    assert after.where("n_chars != length(text)").isEmpty()
    before, after = kept["packing"]
    assert after.count() == pack(before, public_tokenizers.path("byte_bpe_50k.json")).count()


def test_run_leaves_only_its_result(spark, tiny):
    before = set(kept_tables(spark))
    out = corpus_pipeline.run(spark, tiny)
    assert out.count() > 0 and len(set(kept_tables(spark)) - before) == 1
    release(spark, before)
    assert set(kept_tables(spark)) == before
