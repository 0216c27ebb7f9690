"""From raw documents to subword ids: quality, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages work
on all rows that the one before kept.

* quality: documents that the line CRF scores below its threshold go. It learns from the labelled rows of `docs` outside the held-out fold.
* line_dedup: repeated lines go; the text and, where there is one, n_chars change. Documents whose lines all go stay as empty texts.
* near_dup: one document of each near-duplicate class stays: that with the least doc_id (nulls last).
* decontaminate: documents with a twentieth or more of their words in benchmark windows go.
* encode: doc_id, n_pieces and ids of every remaining text.

Null and empty texts are kept by quality if its score for an empty text allows it, have no lines to lose, are near-duplicates of each other, hold no window of a
benchmark and are encoded to no pieces; texts may be as long as a worker's memory allows. An empty table runs through all stages to an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common, decontaminate, line_dedup, near_dup, pieces, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    model = quality.train_from(docs, labels, ~quality.in_fold(F.col("doc_id"), 5, 0))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    found = line_dedup.dedup_lines(docs)
    out = found.drop("__tess_gone")
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return common.leaving(out, *common.left_by(found))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    return pieces.encode(docs, pieces.public_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: No stage but decontamination can be said in SQL: the tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. Once a stage's table is written, the one before it and what the stage has staged for itself are deleted."""
    docs, written = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = common.stage(out, name)
        common.drop_stage(spark, *written, *common.left_by(out))
        written = [docs]
        common.reclaim(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
