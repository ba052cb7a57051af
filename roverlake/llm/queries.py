"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roverlake.llm import conversation_repair, decontaminate, language, line_dedup, merkle, near_dedup, nearest, packing, quality, segment_bpe, sql, substring_dedup, token_files, toxicity
from roverlake.llm.common import fold, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 2


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.selectExpr("id as doc_id", "start", "length", "n_words", "source_id", "source_start")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID, 4096)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    return classes.selectExpr("id as doc_id", "class_id", "id = class_id as kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_documents(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_of(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 0)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_nearest_neighbours, op3_token_files, op4_quality, op5_packing, op6_line_dedup, op7_near_dedup, op8_toxicity, op9_language_id, op10_decontamination, op11_conversation_repair, op12_bpe_round_trip, op13_merkle_manifest)}
ORACLE: dict[str, str] = {"op2_nearest_neighbours": sql.NEAREST, "op6_line_dedup": sql.LINE_DEDUP, "op11_conversation_repair": sql.CONVERSATIONS, "op13_merkle_manifest": sql.MERKLE}
