"""Toxicity by FTRL-proximal logistic regression (operator 8).

The features of a document are the distinct hashes of its words, of its pairs
of neighbouring words and of its pairs with one word between (skip-grams). The
weights are learned by FTRL-proximal: every coordinate has a rate of its own,
and the L1 term keeps all but the useful ones at zero, so that the model is a
short list of slots and weights. Slots that only a few rows of the learning
sample have are left out of learning (they would be learned by heart).

Defined results: a text without a word (null and empty ones too) scores the
bias; without labelled rows of both classes every score is near the share of
label 1. Equal texts score alike.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roverlake.llm.fitting import fit_in_task, held_out, sample
from roverlake.llm.text import GOLDEN, Words, mix, pieces

#: labelled rows learned from, at most
LEARN_ROWS = 16000
BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 20.0, 0.0, 6
#: a slot takes part in learning if so many rows of the sample have it
MIN_ROWS = 4


def _slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, slot) of every word, pair and skip pair."""
    words = Words(texts)
    h, doc = words.hashes, words.doc
    all_docs, all_slots = [doc], [h]
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            same = doc[gap:] == doc[:-gap]
            all_docs.append(doc[gap:][same])
            all_slots.append(mix(h[:-gap] * GOLDEN + h[gap:] + np.uint64(gap))[same])
    slots = np.concatenate(all_slots) >> np.uint64(64 - BITS)
    return np.concatenate(all_docs), slots.astype(np.int64), len(words.first) - 1


def _distinct(doc: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc.astype(np.int64) << BITS | slot)
    return both >> BITS, both & ((1 << BITS) - 1)


def _fit(frame: pd.DataFrame) -> bytes:
    """FTRL-proximal over the rows, several times; slot 2^BITS is the bias, which has no L1 term."""
    frame = frame.sort_values(["_id", "label"], kind="stable")
    rows = [np.frombuffer(x, np.int32) for x in frame["slots"]]
    seen = np.zeros(1 << BITS, np.int64)
    for at in rows:
        seen[at] += 1  # a row's slots are distinct
    rows = [np.append(at[seen[at] >= MIN_ROWS], 1 << BITS) for at in rows]
    y = frame["label"].to_numpy(np.float64).clip(0, 1)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1 = np.full((1 << BITS) + 1, L1)
    l1[-1] = 0
    rng = np.random.default_rng(7)

    def weight(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1[at], 0.0, -(zi - np.sign(zi) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            at = rows[i]
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange((1 << BITS) + 1))
    used = np.flatnonzero(w).astype(np.int32)
    return used.tobytes() + w[used].astype(np.float32).tobytes()


class Model:
    """Sparse weights; the dense table is made once in each worker's task."""

    def __init__(self, raw: bytes | None) -> None:
        n = len(raw or b"") // 8
        self.slots = np.frombuffer(raw or b"", np.int32, n)
        self.weights = np.frombuffer(raw or b"", np.float32, n, offset=4 * n)

    def table(self) -> np.ndarray:
        out = np.zeros((1 << BITS) + 1)
        out[self.slots] = self.weights
        return out


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = LEARN_ROWS) -> Model:
    def features(batches):
        for batch in batches:
            for a, b in pieces(batch.column(2)):
                doc, slot, n = _slots(batch.column(2).slice(a, b - a))
                doc, slot = _distinct(doc, slot)
                edge = np.searchsorted(doc, np.arange(n + 1))
                raw = slot.astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array([raw[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["_id", "label", "slots"])

    chosen = sample(documents, labels, label, rows)
    return Model(fit_in_task(chosen.mapInArrow(features, f"_id {chosen.schema['_id'].dataType.simpleString()}, label int, slots binary"), _fit))


def scores(table: np.ndarray, texts: pa.Array) -> np.ndarray:
    doc, slot, n = _slots(texts)
    used = table[slot] != 0
    doc, slot = _distinct(doc[used], slot[used])
    return 1 / (1 + np.exp(-np.clip(np.bincount(doc, table[slot], n) + table[-1], -35, 35)))


def score(text: Column, model: Model) -> Column:
    """Probability of label 1."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = model.table()
        for texts in batches:
            yield pa.array(np.concatenate([scores(table, texts.slice(a, b - a)) for a, b in pieces(texts)] or [np.empty(0)]))

    return F.arrow_udf(run, "double")(text)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(documents, labels)
    out = documents.select("doc_id", held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
