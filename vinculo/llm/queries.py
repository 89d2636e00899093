"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculo.llm import checks
from vinculo.llm.common import held_out, table
from vinculo.llm.factor_machine import fit_factor_machine, score_documents
from vinculo.llm.host_paths import extract_pages
from vinculo.llm.language import fit_language_model, predict_languages
from vinculo.llm.line_rules import line_verdicts
from vinculo.llm.mtree import top_k
from vinculo.llm.multi_index import mine_negatives
from vinculo.llm.packing import pack_documents
from vinculo.llm.shingle_join import near_duplicates
from vinculo.llm.source_audit import source_divergence
from vinculo.llm.token_transducer import count_tokens
from vinculo.llm.trie_bpe import encode_documents
from vinculo.llm.warc import derivatives, record_bytes, responses_of_pages
from vinculo.llm.window_cuts import window_pieces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    """Register a query under its function name, with its check SQL if it has one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if check is not None:
            CHECKS[fn.__name__] = check
        return fn

    return add


@query(checks.LINES)
def op1_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rules and base counts of all documents."""
    return line_verdicts(table(spark, sf_dir, "documents"))


@query(checks.COMPONENTS)
def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest_only=True)


@query()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.filter(~held_out()))
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op9_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit_factor_machine(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query()
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages' responses, with their serialised form."""
    return record_bytes(derivatives(responses_of_pages(table(spark, sf_dir, "pages"))))


@query(checks.ARTICLES)
def op5_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages by their hosts' winning paths."""
    return extract_pages(table(spark, sf_dir, "pages"))


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM pairs
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """
)
def op3_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products for every vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"))


@query()
def op11_window_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in their order, cut into windows of at most 4096 tokens."""
    return window_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(checks.DIVERGENCE)
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources of a language, and the leading terms of each source."""
    return source_divergence(table(spark, sf_dir, "documents"))


@query(checks.NEGATIVES)
def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor's positives; every seventh row's label is shifted first."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted))
