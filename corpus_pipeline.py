"""From raw documents to token ids: quality, near duplicates, benchmark leaks, personal data, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reqlens.llm import common, decontam, neardup, pieces, pii, quality, queries

BROADCAST_IDS = 2_000_000  # up to so many ids (16 MB) are broadcast; beyond, the texts are shuffled by id


def _without(docs: DataFrame, ids: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The documents whose id is not among ``ids`` (one column); rows without a key stay."""
    gone = scratch.keep(ids.toDF("__gone_id").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == F.col("__gone_id"), "left_anti")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows without an id get one that follows from their text, from 2 ** 62 on, so that stages can decide on them.

    Equal texts share it, which is right for decisions that depend on the text alone; two different texts share
    one with probability 2 ** -62. Rows without an id and without words keep none.
    """
    key = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    own = F.when(F.col("doc_id").isNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), key)
    return docs.withColumns({"__nameless": own.isNotNull(), "doc_id": F.coalesce(F.col("doc_id").cast("bigint"), own)})


def _unkeyed(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows as they were before ``_keyed``."""
    own = F.when(~F.col("__nameless"), F.col("doc_id")).cast(docs.schema["doc_id"].dataType)
    return kept.withColumn("doc_id", own).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    common.ship_package(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = quality.score_column(model, F.coalesce("text", F.lit("")), docs)
    return docs.withColumn("__quality", score).filter(F.col("__quality") >= quality.THRESHOLD).drop("__quality")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows that share an id count as one document: the one with the smallest text stays. Of copies without an id one
    stays, and none if a copy with an id does; rows without an id and without words stay.
    """
    common.ship_package(spark)
    scratch, given = common.Scratch(spark, "one-copy"), docs
    docs = _keyed(given)
    found = scratch.keep(neardup.near_duplicates(docs).select("doc_id", "kept"), "found")
    ids = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("kept").alias("kept"))
    chosen = scratch.keep(ids.filter("rows > 1 or not kept"), "chosen")
    single = _without(docs, chosen.select("doc_id"), scratch)
    again = chosen.filter("kept").select(F.col("doc_id").alias("__again_id"))
    first = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns))
    repeated = (docs.join(again, docs["doc_id"] == F.col("__again_id"), "left_semi")
                .withColumn("__turn", F.row_number().over(first)).filter("__turn = 1").drop("__turn"))
    return _unkeyed(single if again.isEmpty() else single.unionByName(repeated), given)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Rows with one id share their matches; rows without one are judged by their text."""
    benchmark, keyed = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _keyed(docs)
    leaks = decontam.contamination(keyed, benchmark).filter("contaminated and doc_id is not null").select("doc_id")
    return _unkeyed(_without(keyed, leaks, common.Scratch(spark, "leaks")), docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    common.ship_package(spark)
    return pieces.encode_documents(docs, queries.tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good), ("near_duplicates", keep_one_copy), ("decontamination", drop_leaks), ("pii", mask_private),
    ("sentencepiece", encode),
]
ORACLE_SQL = None  # the first stage is a fitted classifier


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
