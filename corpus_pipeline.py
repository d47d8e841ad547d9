"""From raw documents to training ids in five stages; each works on all that the one before has kept.

quality rules -> line dedup -> near-duplicate removal -> benchmark decontamination -> SentencePiece ids. A stage takes
(spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Between stages the rows are
written as Parquet and read again, so that a lost executor costs at most the stage at hand.

A document that line dedup leaves without a word is dropped there: all of it stands in other documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import anti_join_some, documents, staged
from attestor.llm.decontaminate import leaks
from attestor.llm.line_dedup import WHOLE, dedup_lines
from attestor.llm.near_dedup import NearDup, near_groups
from attestor.llm.pieces import encode
from attestor.llm.quality import judged

#: Not expressible in SQL: SimHash and MinHash joins, and Viterbi; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judged(docs).where("kept_by_rules").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs, WHOLE).where("n_removed = 0 or text rlike '[^ \\\\t-\\\\r]'")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _without(docs: DataFrame, going: DataFrame) -> DataFrame:
    going = staged(going.select(F.col("doc_id").alias("_id")).distinct(), "pipeline-going")
    return anti_join_some(docs.withColumn("_id", F.col("doc_id").cast("long")), going, "_id").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, near_groups(docs, NearDup(shingle=5)).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, leaks(docs, documents(spark, sf_dir, "benchmark")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
