"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Stages keep all columns of their input, whatever their names; only text and n_chars change, and only where words go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm.minhash import judged
from capturelake.llm.packing import pack_documents
from capturelake.llm.quality import fit
from capturelake.llm.queries import TRAINING, vocabulary
from capturelake.llm.scratch import Scratch, free_name, quoted
from capturelake.llm.substring import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives label 1; vectors and weights come from the stage's own input.

    Null and empty texts are judged as the empty text; rows are judged each by their own whole text, whatever their ids.
    Without labels every score is 0.5, and all documents stay.
    """
    model, score = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name("_quality", docs.columns)
    return model.score(docs, *docs.columns, into=score).where(F.col(quoted(score)) >= 0.5).select(*map(quoted, docs.columns))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 and more.

    The smallest doc_id stays, and of several texts of that id in a group the one with the smallest hash.  Rows that repeat a
    doc_id and its text stay once; texts of one id that are no near duplicates stay each.  Rows without a doc_id stay, and so
    do texts without words (null ones too), which are near to nothing.
    """
    scratch, names = Scratch(spark, "pipeline-minhash"), [free_name(n, docs.columns) for n in ("_doc", "_text", "_gone", "_each")]
    *keys, gone, each = names
    found = judged(docs, shingle=5, threshold_pct=80).where("doc_id IS NOT NULL")
    found = scratch.save(found.select(F.col("doc_id").alias(keys[0]), F.col("text_hash").alias(keys[1]), "part"), "judged")
    first = found.where("part IS NOT NULL").groupBy("part").agg(F.min(F.struct(*keys)).alias("x")).select("x.*")
    stay = first.unionByName(found.where("part IS NULL").select(*keys)).distinct().withColumn("stays", F.lit(True))
    counted = found.groupBy(*keys).agg(F.count("*").alias("rows")).join(stay, keys, "left")
    marks = scratch.save(counted.where("stays IS NULL OR rows > 1").select(*keys, F.col("stays").isNull().alias(gone)), "marks")
    # only rows that go or repeat, and the few that a filter takes for such, are moved with their texts
    rows = docs.withColumns({keys[0]: F.col("doc_id").cast("long"), keys[1]: F.xxhash64(F.col("text").cast("string"))})
    marked = scratch.save_filter(marks.select(*keys), "filter").holds(*keys)
    some = rows.where(marked).join(marks, keys, "left").where(~F.coalesce(gone, F.lit(False)))
    some = some.withColumn(each, F.when(F.col(gone).isNull(), F.monotonically_increasing_id())).dropDuplicates([*keys, each])
    return rows.where(~marked).unionByName(some.drop(gone, each)).select(*map(quoted, docs.columns))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words and more that a document with a smaller doc_id has.

    Texts without any stay as they are, others become their kept words joined by one blank (the empty text if none is kept).
    Null texts stay null; rows without a doc_id stay as they are; rows that repeat a doc_id are judged each by their own text.
    """
    removed = free_name("_removed", docs.columns)
    out = without_repeats(docs, removed)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(quoted(removed)) > 0, size).otherwise(F.col("n_chars")))
    return out.select(*map(quoted, docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048; every row is packed once, a null or empty text as its final id alone."""
    return pack_documents(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), digest=True, **TRAINING)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("minhash", minhash), ("substring", substring), ("packing", packing)]

#: SQL cannot express the stages (a trained network, MinHash buckets, a tokenizer); tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents`` of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
