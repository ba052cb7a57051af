"""A training corpus from raw documents: each stage applies one operator.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each stage's rows as Parquet to the shared folder and reads them back
as the next stage's input. All stages but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roverlake.llm import decontaminate, language, line_dedup, near_dedup, packing
from roverlake.llm.common import new_folder, table
from roverlake.llm.queries import END_ID, VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: a document stays if one language has at least this share of its words
MIN_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified main language go."""
    model = language.learn(docs)
    found = docs.select(*COLUMNS, language.identify(F.col("text"), model).alias("_identified"))
    return found.where((F.col("_identified.lang_pred") != language.UNDETERMINED) & (F.col("_identified.score") >= MIN_SHARE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; a document of which nothing is
    left goes."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    stays = (F.col("removed_lines") == 0) | F.col("text").rlike("\\S")
    return out.where(stays).withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the smallest id. Of rows
    with the same id and text one stays; a text of its own stays though its id has
    others, and so do documents without id."""
    later = near_dedup.later_copies(docs).withColumnsRenamed({"id": "doc_id", "t": "_text"})
    kept = docs.select(*COLUMNS, F.xxhash64("text").alias("_text")).join(later, later.columns, "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not twice.isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "_text"]).unionByName(kept.where("doc_id is null"))
    return kept.select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaked = decontaminate.contaminated(F.col("text"), table(spark, sf_dir, "benchmark"))
    return docs.select(*COLUMNS, leaked.alias("_leaked")).where(~F.col("_leaked")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), END_ID, 4096)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminated),
    ("packing", pack),
]

#: SQL expresses neither the mixture model nor the tokeniser; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
