"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reqlens.llm import (common, decontam, langid, neardup, neighbours, pieces, pii, quality, repair, resample, secretscan, sql,
                         tokenfiles, toxicity, urlfilter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def tokenizer_file(name: str) -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, oracle: str | None = None):
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.ship_package(spark)
            return function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register


@query("op1_pii", sql.PII)
def op1(table) -> DataFrame:
    return pii.pii_digest(table("documents"))


@query("op2_neighbours")
def op2(table) -> DataFrame:
    vectors = table("embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


@query("op3_decontamination", sql.DECONTAMINATION)
def op3(table) -> DataFrame:
    return decontam.contamination(table("documents"), table("benchmark"))


@query("op4_secrets")
def op4(table) -> DataFrame:
    return secretscan.secrets_digest(table("documents"))


@query("op5_sentencepiece")
def op5(table) -> DataFrame:
    return pieces.ids_digest(pieces.encode_documents(table("documents"), tokenizer_file("piece_bpe_32k.model")))


@query("op6_quality")
def op6(table) -> DataFrame:
    return quality.score_documents(table("documents"), table("labels"))


@query("op7_near_duplicates", sql.NEAR_DUPLICATES)
def op7(table) -> DataFrame:
    return neardup.near_duplicates(table("documents"))


@query("op8_toxicity")
def op8(table) -> DataFrame:
    return toxicity.score_documents(table("documents"), table("labels"))


@query("op9_token_files")
def op9(table) -> DataFrame:
    return tokenfiles.token_file_digest(table("documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


@query("op10_url_filter", sql.URL_FILTER)
def op10(table) -> DataFrame:
    return urlfilter.judge_urls(table("pages"), RULES)


@query("op11_conversation_repair")
def op11(table) -> DataFrame:
    return repair.repair(repair.damaged(table("conversations")), F.col("present"))


@query("op12_language_id")
def op12(table) -> DataFrame:
    return langid.identify(table("documents"))


@query("op13_importance_resampling")
def op13(table) -> DataFrame:
    return resample.resample(table("documents"), table("benchmark"))
