"""The operators applied to the whole test tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import oracle
from tillroll.llm.common import read_table
from tillroll.llm.conversations import conversation_query
from tillroll.llm.decontamination import contamination_query
from tillroll.llm.filteraudit import audit_query
from tillroll.llm.langid import language_query
from tillroll.llm.linededup import line_dedup_query
from tillroll.llm.linedistribution import extract
from tillroll.llm.neardedup import near_dedup_query
from tillroll.llm.packing import pack
from tillroll.llm.repetition import judge
from tillroll.llm.secretscan import secret_query
from tillroll.llm.sentencepieces import sentencepiece_query
from tillroll.llm.sharding import shard_documents
from tillroll.llm.trainingorder import materialise


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


QUERIES = {
    "op1_secret_scan": lambda s, d: secret_query(_documents(s, d)),
    "op2_html_extraction": lambda s, d: extract(read_table(s, d, "pages")),
    "op3_quality_rules": lambda s, d: judge(_documents(s, d)),
    "op4_packing": lambda s, d: pack(_documents(s, d)),
    "op5_line_dedup": lambda s, d: line_dedup_query(_documents(s, d)),
    "op6_decontamination": lambda s, d: contamination_query(
        _documents(s, d), read_table(s, d, "benchmark")
    ),
    "op7_training_order": lambda s, d: materialise(_documents(s, d)),
    "op8_near_dedup": lambda s, d: near_dedup_query(_documents(s, d)),
    "op9_language_id": lambda s, d: language_query(_documents(s, d)),
    "op10_sharding": lambda s, d: shard_documents(_documents(s, d)),
    "op11_sentencepiece": lambda s, d: sentencepiece_query(_documents(s, d)),
    "op12_filter_audit": lambda s, d: audit_query(_documents(s, d), read_table(s, d, "labels")),
    "op13_conversation_repair": lambda s, d: conversation_query(read_table(s, d, "conversations")),
}

ORACLE = {
    "op5_line_dedup": oracle.LINE_DEDUP,
    "op6_decontamination": oracle.DECONTAMINATION,
    "op8_near_dedup": oracle.NEAR_DEDUP,
    "op12_filter_audit": oracle.FILTER_AUDIT,
}
