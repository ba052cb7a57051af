"""Fitting a document classifier on a bounded sample of labelled rows.

The sample is chosen by the hash of the document id, so it is the same on any
cluster; features are made where the documents lie, and one task fits the
model. Its size is bounded by the sample, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roverlake.llm.common import fold

FOLDS = 5


def held_out(key: str = "doc_id"):
    """Fold 0 of the ids is never learned from; a null id is not held out."""
    return F.coalesce(fold(key, FOLDS) == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, label, text) of at most ``rows`` labelled documents of the learning folds: the
    smallest hashes of the id. An id with several labels has the largest."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(~held_out(key))
    known = known.groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    docs = documents.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text"))
    return docs.join(F.broadcast(known), "_id").select("_id", "label", "text")


def fit_in_task(features: DataFrame, fit: Callable[[pd.DataFrame], bytes]) -> bytes | None:
    """Run ``fit`` once over all rows of a bounded table, on an executor; None if there are none."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [fit(frame)]})

    got = features.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "model binary").collect()
    return got[0]["model"] if got else None
