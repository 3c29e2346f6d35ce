"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, fim, html_text, jaccard, katz, neardup, oracle, packing, quality, repeats, search, spm, token_counts, urls
from .common import ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Trees, backoff models, packings and suffix orders can't be said in SQL; tests use brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": oracle.JACCARD,
    "op6_exact_top_k": oracle.TOP_K,
    "op7_url_filter": oracle.URLS,
    "op8_embedding_near_dedup": oracle.NEAR_VECTORS,
    "op12_fill_in_middle": oracle.FIM,
    "op13_conversation_repair": oracle.CONVERSATIONS,
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@_query("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op1_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


@_query("op2_ngram_jaccard_join")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_groups(_table(spark, folder, "documents"))


@_query("op9_suffix_array_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeats(_table(spark, folder, "documents"))


@_query("op4_katz_scoring")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return katz.lm_scores(_table(spark, folder, "documents"))


@_query("op6_exact_top_k")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    return search.top_k(rows.where("vec_id % 50 = 0"), rows)


@_query("op8_embedding_near_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_vectors(_table(spark, folder, "embeddings"))


@_query("op7_url_filter")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return urls.url_verdicts(_table(spark, folder, "pages"))


@_query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"))


@_query("op5_sentencepiece")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return spm.digest(spm.encode(_table(spark, folder, "documents")))


@_query("op12_fill_in_middle")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digest(fim.transform(_table(spark, folder, "documents")))


@_query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.digest(conversations.damage(_table(spark, folder, "conversations")))


@_query("op11_html_extraction")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))
