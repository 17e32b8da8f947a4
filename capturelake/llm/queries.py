"""Queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a training sequence: tokens, documents' pieces, and tokens that bear loss; the first ``context`` tokens of a
#: document bear none, so each sequence needs as many of such tokens as the last limit leaves.
TRAINING = {"tokens": 2048, "segments": 16, "loss": 2032, "context": 16}

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, threshold_pct=80)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, held_out

    docs = _table(spark, sf_dir, "documents")
    scored = fit(docs, _table(spark, sf_dir, "labels")).score(docs, "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), digest=True, **TRAINING)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import quoted_mail, reply_order

    # the table holds no quoted line of its own
    return reply_order(quoted_mail(_table(spark, sf_dir, "conversations")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import digests

    return digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name)}


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLE

    return dict(ORACLE)
