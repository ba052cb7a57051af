"""Quality classifier by supervised subword embeddings (operator 4).

A document is the average of learned vectors of its hashed character n-grams
plus the average of those of its hashed words; a softmax over the two classes
reads the sum. Vectors and output weights are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. As output and average
are linear, scoring needs one number for each hash slot, and whole batches of
texts are scored with a few array passes.

Defined results: a null or empty text has no feature and scores the model's
bias; without labelled rows of both classes every score is the share of label 1
(0.5 without any). Equal texts score alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roverlake.llm.fitting import fit_in_task, held_out, sample
from roverlake.llm.text import GOLDEN, Words, pieces

#: labelled rows learned from, at most
LEARN_ROWS = 4000
BITS, WIDTH, EPOCHS, RATE = 16, 8, 8, 20.0
ORDERS = (2, 3, 4)
#: slots of the character n-grams, then those of the words, then "same word again"
CHARS = 1 << BITS
AGAIN = 2 * CHARS
SLOTS = AGAIN + 1


def _spaced() -> np.ndarray:
    ok = np.ones(256, bool)
    ok[list(b" \t\r\n")] = False
    return ok


def _features(texts: pa.Array):
    """(offsets of the texts in bytes, [(slots, valid)] by n-gram order, word slots,
    whether a word repeats the one before, first word of each text). A text ends in a line feed."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    words = Words(ended, keep=_spaced(), lower=False)
    data, off = words.data, words.offsets
    code, n = data.astype(np.uint64), len(data)
    since = np.arange(n) - np.repeat(off[:-1], np.diff(off))  # place in the text
    grams = []
    for k in range(1, max(ORDERS)):
        code[k:] |= data[:n - k].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in ORDERS:
            with np.errstate(over="ignore"):
                slot = ((code + np.uint64((k + 1) << 40)) * GOLDEN) >> np.uint64(64 - BITS)
            grams.append((slot.astype(np.int32), since >= k))
    slots = (words.hashes >> np.uint64(64 - BITS)).astype(np.int32) + CHARS
    again = np.zeros(len(slots), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    return off, grams, slots, again, words.first


def _sparse(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text its distinct slots and their weights in the two averages."""
    off, grams, words, again, first = _features(texts)
    ids, weights = [], []
    for i in range(len(off) - 1):
        part = slice(off[i], off[i + 1])
        chars = np.concatenate([s[part][ok[part]] for s, ok in grams])
        own = words[first[i]:first[i + 1]]
        here, times = np.unique(chars, return_counts=True)
        there, often = np.unique(np.concatenate([own, np.full(again[first[i]:first[i + 1]].sum(), AGAIN)]), return_counts=True)
        ids.append(np.concatenate([here, there]).astype(np.int32))
        weights.append(np.concatenate([times / max(1, len(chars)), often / max(1, len(own))]).astype(np.float32))
    return ids, weights


def _fit(frame: pd.DataFrame) -> bytes:
    """Stochastic gradient descent, one document at a time; returns the slot scores and the bias."""
    frame = frame.sort_values(["_id", "label"], kind="stable")
    ids = [np.frombuffer(x, np.int32) for x in frame["ids"]]
    weights = [np.frombuffer(x, np.float32) for x in frame["weights"]]
    y = frame["label"].to_numpy(np.int64).clip(0, 1)
    share = float(y.mean())
    out = np.zeros(SLOTS + 1, np.float32)
    if share in (0.0, 1.0):
        out[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return out.tobytes()
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (SLOTS, WIDTH)).astype(np.float32)
    output, bias = np.zeros((WIDTH, 2), np.float32), np.log(np.array([1 - share, share], np.float32))
    step, total = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = 1 - step / total
            step += 1
            hidden = weights[i] @ vectors[ids[i]]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1  # gradient of the loss by the logits
            back = output @ p
            output -= 0.2 * rate * np.outer(hidden, p)
            bias -= 0.05 * rate * p
            vectors[ids[i]] -= RATE * rate * weights[i][:, None] * back
    out[:SLOTS] = vectors @ (output[:, 1] - output[:, 0])
    out[-1] = bias[1] - bias[0]
    return out.tobytes()


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LEARN_ROWS) -> np.ndarray:
    """Scores of all slots, and the bias last."""

    def features(batches):
        for batch in batches:
            for a, b in pieces(batch.column(2)):
                ids, weights = _sparse(batch.column(2).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in weights], pa.binary())], names=["_id", "label", "ids", "weights"])

    chosen = sample(documents, labels, label, rows)
    model = fit_in_task(chosen.mapInArrow(features, f"_id {chosen.schema['_id'].dataType.simpleString()}, label int, ids binary, weights binary"), _fit)
    return np.frombuffer(model, np.float32) if model else np.zeros(SLOTS + 1, np.float32)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of values[edges[i]:edges[i+1]] for each i."""
    out = np.zeros(len(edges) - 1)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        out[full] = np.add.reduceat(values, edges[full])
    return out


def scores(model: np.ndarray, texts: pa.Array) -> np.ndarray:
    off, grams, words, again, first = _features(texts)
    value, valid = 0.0, 0
    for slot, ok in grams:
        value = value + np.where(ok, np.take(model, slot), 0)
        valid = valid + ok
    chars = _sums(value.astype(np.float64), off) / np.maximum(_sums(valid, off), 1)
    own = _sums(np.take(model, words) + np.float64(model[AGAIN]) * again, first) / np.maximum(np.diff(first), 1)
    return 1 / (1 + np.exp(-np.clip(chars + own + model[-1], -50, 50)))


def score(text: Column, model: np.ndarray) -> Column:
    """Probability of label 1."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([scores(model, texts.slice(a, b - a)) for a, b in pieces(texts)] or [np.empty(0)]))

    return F.arrow_udf(run, "double")(text)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(documents, labels)
    out = documents.select("doc_id", held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
