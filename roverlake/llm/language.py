"""Language ID by mixture inference (operator 9).

Every language has a smoothed distribution over hashed byte n-grams of words,
learned from labelled documents. A document is a mixture: each word comes from
one language, and expectation-maximisation estimates the proportions from the
words' n-gram likelihoods. The language set of a document is the nested set
(by proportion) with the best likelihood less ``penalty * log(words)`` for
each language in it; the predicted language has the largest proportion in it.
Sets of every size are tried until none larger can be better for any text.

Defined results: a null text, or one without any letter, is ``und`` with score
0; so is every text if there is nothing to learn from. Equal proportions go to
the language that sorts first. A null id is never held out nor learned from.
Repeated rows are scored alike; other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roverlake.llm.common import fold
from roverlake.llm.text import GOLDEN, Words, pieces

UNDETERMINED = "und"
BITS = 16
#: n-gram lengths in bytes, word ends included
ORDERS = (2, 3, 4)
#: labelled documents learned from, about so many for each language value
LEARN_DOCS = 1500
RESULT = "struct<lang_pred: string, score: double, languages: array<string>>"


@dataclass
class Model:
    """languages: sorted names. table: log-probability of each n-gram slot, (languages, slots)."""

    languages: list[str]
    table: np.ndarray


def _letters() -> np.ndarray:
    ok = np.zeros(256, bool)
    for c in b"abcdefghijklmnopqrstuvwxyz":
        ok[c] = True
    ok[128:] = True
    return ok


def _slots(texts: pa.Array) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of the texts; for each order the slots of its n-grams and the word that each ends in."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    words = Words(ended, keep=_letters())
    n = len(words.data)
    spell = np.where(_letters()[words.data], words.data, 0).astype(np.uint64)
    # each word's bytes and the end mark after it (a text ends in a line feed)
    lengths = words.ends - words.starts + 1
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.empty(0, np.int64)
    at = np.arange(lengths.sum()) + np.repeat(words.starts - first, lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    out = []
    code = spell.copy()
    for k in range(1, max(ORDERS)):
        code[k:] |= spell[:n - k] << np.uint64(8 * k)
        if k + 1 in ORDERS:
            with np.errstate(over="ignore"):
                slot = ((code[at] + np.uint64((k + 1) << 40)) * GOLDEN) >> np.uint64(64 - BITS)
            out.append((slot.astype(np.int64), owner))
    return words, out


def _counts(texts: pa.Array) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for a, b in pieces(texts):
        for slot, _ in _slots(texts.slice(a, b - a))[1]:
            total += np.bincount(slot, minlength=1 << BITS)
    return total


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = LEARN_DOCS) -> Model:
    """n-gram counts of about ``per_language`` documents of each language, or of all
    if it has fewer: those with a hash of their id below that share of the language's
    documents. Counted on the executors; what returns to the driver is one count
    vector for each language."""
    rows = labelled.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("id is not null and lang is not null and text is not null")
    shares = {r["lang"]: min(1.0, per_language / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return Model([], np.zeros((0, 1 << BITS), np.float32))
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])[F.col("lang")]
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, texts = batch.column(0), batch.column(1)
            for value in pc.unique(lang).to_pylist():
                got = _counts(texts.filter(pc.equal(lang, value)))
                sums[value] = sums[value] + got if value in sums else got
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BITS, np.int64)
        for v in frame["counts"]:
            total += np.frombuffer(v, np.int64)
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "counts": [total.tobytes()]})

    kind = "lang string, counts binary"
    found = sorted(rows.mapInArrow(count, kind).groupBy("lang").applyInPandas(add, kind).collect())
    if not found:
        return Model([], np.zeros((0, 1 << BITS), np.float32))
    counts = np.stack([np.frombuffer(r["counts"], np.int64) for r in found]) + 0.3
    return Model([r["lang"] for r in found], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def _em(like: np.ndarray, words: Words, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture proportions (language, document) over the allowed languages, and the
    log-likelihood of each document. ``like``: (language, word) likelihoods scaled
    to a maximum of 1, words in document order."""
    doc, n = words.doc, np.diff(words.first)
    full = np.flatnonzero(n)
    at = words.first[full]
    share = (allowed / allowed.sum(axis=0)).astype(np.float32)
    for _ in range(rounds):
        part = np.take(share, doc, axis=1)
        part *= like
        part /= np.maximum(part.sum(axis=0), 1e-30)
        share = share.copy()
        share[:, full] = np.add.reduceat(part, at, axis=1) / n[full] if len(full) else 0
    fit = np.zeros(len(n))
    if len(full):
        fit[full] = np.add.reduceat(np.log(np.maximum((np.take(share, doc, axis=1) * like).sum(axis=0), 1e-30).astype(np.float64)), at)
    return share, fit


def infer(model: Model, texts: pa.Array, penalty: float = 2.0, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: index of the language (-1: no word), its share, and the chosen
    set, (language, text) of 0 and 1."""
    words, grams = _slots(texts)
    docs, kinds, count = len(words.first) - 1, len(model.languages), np.diff(words.first)
    like = np.zeros((kinds, len(words.starts)))
    if len(words.starts):
        at = np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)[:-1]])
        for k in range(kinds):
            logs = sum(np.take(model.table[k], slot) for slot, _ in grams)
            like[k] = np.add.reduceat(logs, at) / len(grams)
        like = np.exp(like - like.max(axis=0)).astype(np.float32)
    share, _ = _em(like, words, np.ones((kinds, docs)), rounds)
    rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0, kind="stable")
    best = np.full(docs, -np.inf)
    chosen, shares = np.zeros((kinds, docs)), share
    for k in range(1, kinds + 1):
        # no likelihood is above 1 (the scale of ``like``): at the bound no larger set is better for any text
        if (best >= -penalty * k * np.log1p(count) + 1e-6 * count).all():
            break
        allowed = (rank < k).astype(np.float64)
        got, fit = _em(like, words, allowed, rounds // 2 if k > 1 else 0)
        worth = fit - penalty * k * np.log1p(count)
        better = worth > best
        best[better] = worth[better]
        chosen[:, better], shares = allowed[:, better], np.where(better, got, shares)
    top = np.argmax(shares, axis=0)
    score = shares[top, np.arange(docs)]
    # a set of one language has share 1; its score is the share in the full mixture
    lone = chosen.sum(axis=0) == 1
    score[lone] = share[top[lone], np.flatnonzero(lone)]
    top[count == 0] = -1
    return top, np.clip(score.astype(np.float64), 0.0, 1.0), chosen


def identify(text: Column, model: Model) -> Column:
    """Struct of lang_pred, score and the document's languages."""
    names = np.array([*model.languages, UNDETERMINED], dtype=object)

    def predict(texts: pa.Array) -> pa.Array:
        langs, scores, sets = [], [], []
        for a, b in pieces(texts) if model.languages else []:
            top, score, chosen = infer(model, texts.slice(a, b - a))
            langs.extend(names[top])
            scores.extend(np.where(top < 0, 0.0, score))
            sets.extend([names[:-1][row > 0].tolist() if t >= 0 else [] for row, t in zip(chosen.T, top, strict=True)])
        if not model.languages:
            langs, scores, sets = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[]] * len(texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], ["lang_pred", "score", "languages"])

    found = F.arrow_udf(predict, RESULT)(text)
    none = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("languages"))
    lettered = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    return F.when(lettered, found).otherwise(none)


def predict_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every document, with a model
    learned from the documents whose fold is not 2."""
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = learn(documents.where(~held))
    return documents.select("doc_id", held.alias("held_out"), identify(F.col("text"), model).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score", "r.languages")
