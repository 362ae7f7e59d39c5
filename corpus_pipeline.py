"""A corpus pipeline of five stages, each over all that the one before it kept.

1. language_id: documents whose language cannot be told go.
2. line_dedup: lines that an earlier document has go; a document left without a word goes.
3. near_dedup: of documents with a similarity of 0.8 or more in five-word shingles, and
   what hangs together by that, the one of the smallest id stays.
4. decontamination: documents with 5 % or more of their words in benchmark passages go.
5. packing: the rest becomes sequences of 4096 token ids; a row per piece.

A stage is written as Parquet in the shared folder and read again as the next one's
documents. Stages 1 to 4 return the columns of documents, with n_chars kept true.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.llm.common import read_table, stored  # noqa: E402
from tillroll.llm.decontamination import find_contamination, judged  # noqa: E402
from tillroll.llm.langid import keep_identified  # noqa: E402
from tillroll.llm.linededup import dedup_lines  # noqa: E402
from tillroll.llm.neardedup import keep_one  # noqa: E402
from tillroll.llm.packing import pack  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs).where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\s]"))
    changed = kept.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn(
            "n_chars",
            F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")),
        )
    return changed.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = judged(find_contamination(docs, read_table(spark, sf_dir, "benchmark")))
    return found.where("NOT contaminated").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# SQL has neither the language model nor the tokenizer; tests hold run() against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
