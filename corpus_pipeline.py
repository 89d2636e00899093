"""The corpus pipeline: language, quality, near duplicates, packing, each stage over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculo.llm.common import held_out, materialize, only_ids
from vinculo.llm.language import fit_language_model, keep_languages
from vinculo.llm.line_rules import clean_documents
from vinculo.llm.packing import pack_documents
from vinculo.llm.shingle_join import near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least one half; the model learns outside the held-out fold."""
    return keep_languages(docs, fit_language_model(docs.filter(~held_out())))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines."""
    return clean_documents(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; of repeated rows one. Documents without an id all stay."""
    found = materialize(near_duplicates(docs).filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "kept-ids")
    kept = only_ids(docs, found.filter("rows = 1"))
    repeated = found.filter("rows > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(only_ids(docs, repeated).dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicate), ("packing", packing)]

#: Language models, line rules and tokenizers have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
