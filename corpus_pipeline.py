"""The corpus pipeline: language, toxicity, copies, benchmark passages, tokens.

Each stage gets the documents that the one before it kept and works on all of them.  Nulls,
empty and long texts, repeated rows and empty tables are treated as each operator's function
says: a text without letters goes with the first stage, of copies one row stays, a text
that is all benchmark goes with the fourth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import bpe_codec, decontaminate, jaccard_join, language_id, toxicity
from folioscope.llm.stages import SMALL, discard, discard_one, limit_batches, scratch_path, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no known language go.  Batches are small from here on: what one stage has made an executor take, the next ones don't get back."""
    limit_batches(spark, SMALL)
    return language_id.drop_foreign(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts predicted toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id stays."""
    return jaccard_join.keep_first(docs, size=5, num=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and digests of them and of what they decode to."""
    return bpe_codec.bpe_roundtrip(docs, bpe_codec.vocabulary(), keep_ids=True, keep_text=False)


STAGES = [("language_id", language), ("toxicity", toxic), ("jaccard_join", copies), ("decontaminate", benchmark), ("bpe_codec", tokens)]

#: Fitted models and token merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each one written and read again; what a stage wrote
    on its way is removed when its result is written, and its input too."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, mark = scratch_path(spark, f"pipeline-{name}"), written()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, mark)
        if before is not None:
            discard_one(spark, before)
        before = path
    return docs
