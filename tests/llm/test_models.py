"""Classifiers by held-out accuracy, language ID, decontamination and nearest neighbours by brute force."""

import ast
import os
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpora import SF_SMALL, edges, empty, prose
from roverlake.llm import decontaminate, language, nearest, quality, toxicity
from roverlake.llm.common import table

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_quality_on_held_out_rows(spark):
    got = quality.score_documents(table(spark, SF, "documents"), table(spark, SF, "labels")).join(table(spark, SF, "labels"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.97


def test_toxicity_finds_words_it_learned(spark):
    rows, labels = [], []
    for i in range(600):
        text = prose(i, 60).split(" ")
        if i % 5 == 0:
            text[7] = ["vilest", "foulest", "meanest"][i % 3]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    got = toxicity.score_documents(docs, known).collect()
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in got if r.held_out]) >= 0.98


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifier_edges(spark, operator):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (9, 1, 0), (9, 0, 1), (77, 1, 1)], LABELS)
    for known in (labels, labels.where("false"), labels.where("doc_id = 1")):
        got = operator.score_documents(edges(spark), known)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"]
        rows = got.collect()
        assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1  # null is empty
        assert len({r.score for r in rows if r.doc_id in (1, 5)}) == 1
    assert operator.score_documents(empty(spark), labels).count() == 0


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    got = language.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97


def test_language_mixture(spark):
    """A text of two halves is found to hold both languages in equal shares."""
    docs = {r.lang: r.text for r in table(spark, SF, "documents").where(F.length("text").between(3000, 4000)).select("lang", "text").collect()}
    model = language.learn(table(spark, SF, "documents"))
    mixed = docs["fr"][:2500] + "\n" + docs["de"][:2500]
    top, score, chosen = language.infer(model, pa.array([mixed, docs["en"]]))
    assert {model.languages[i] for i in np.flatnonzero(chosen[:, 0])} == {"de", "fr"} and 0.35 < score[0] < 0.65
    assert model.languages[top[1]] == "en" and score[1] > 0.9


def test_language_mixture_of_four(spark):
    """A text of four languages is found to hold all of them, none with half of its words."""
    docs = {r.lang: r.text for r in table(spark, SF, "documents").where(F.length("text").between(3000, 4000)).select("lang", "text").collect()}
    model = language.learn(table(spark, SF, "documents"))
    assert len(docs) == len(model.languages) == 4
    texts = ["\n".join(docs[x][:2800 if x == first else 1400] for x in docs) for first in docs]
    top, score, chosen = language.infer(model, pa.array(texts))
    assert [model.languages[i] for i in top] == list(docs) and chosen.all()
    assert ((score > 0.25) & (score < 0.5)).all()


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(1)
    texts = pa.array([prose(i, 50) for i in range(5)])
    words, _ = language._slots(texts)
    like = rng.random((3, len(words.starts))).astype(np.float32)
    fits = [language._em(like, words, np.ones((3, 5)), k)[1] for k in range(6)]
    assert all((b >= a - 1e-4).all() for a, b in zip(fits, fits[1:], strict=False))


def test_language_edges(spark):
    docs = edges(spark)
    for known in (docs, docs.withColumn("lang", F.lit("xx"))):
        rows = language.predict_documents(known).collect()
        assert len(rows) == 15
        assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (2, 3, 4, 12))
    assert next(r for r in rows if r.doc_id == 1).lang_pred == "xx"
    assert language.predict_documents(empty(spark)).count() == 0


def bag(words, k):
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute_leaks(docs, items):
    split = lambda t: re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (t or "").lower())
    out = {}
    for i, text in docs:
        words = split(text)
        for j, item in items:
            own = split(item)
            k = min(5, len(own))
            if not k:
                continue
            want = bag(own, k)
            for at in range(len(words) - k + 1):
                got = bag(words[at:at + len(own)], k)
                shared = sum((got & want).values())
                score = shared / (sum(got.values()) + sum(want.values()) - shared)
                if score >= 0.8 and score > out.get((i, j), (0,))[0]:
                    out[i, j] = (score, at)
    return {k: (round(s, 9), at) for k, (s, at) in out.items()}


def test_leaks_equal_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents").where("length(text) < 2000")
    items = table(spark, SF_SMALL, "benchmark")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in decontaminate.leaks(docs, items).collect()}
    assert got == brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_leaks_with_edits_and_short_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)  # several blocks of items
    items = [(i, prose(400 + i, 8 + 9 * i, 8 + 9 * i)) for i in range(12)] + [(50, "alpha beta gamma"), (51, None), (52, " "), (53, "alpha beta gamma")]
    docs = []
    for i in range(48):
        own, item = prose(700 + i, 80, 80).split(" "), items[i % 12][1].split(" ")
        if i % 4 == 1:
            item[len(item) // 2] = "changed"
        if i % 4 == 2:
            item.insert(3, "added")
        if i % 4 == 3:
            item = item[:len(item) // 2]
        docs.append((i, " ".join(own[:i] + item + own[i:])))
    docs += [(100, items[8][1]), (101, " ".join(items[8][1].split(" ")[:-3])), (102, "so Alpha, beta; GAMMA"), (103, items[5][1] + " " + items[5][1])]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: score for k, (score, _) in want.items()}
    assert all(r.start_word >= want[r.doc_id, r.item_id][1] for r in got)  # windows start with a shared shingle
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_no_fingerprint_within_the_radius_is_missed():
    """The block lists give every item of the length whose print is within the radius."""
    rng = np.random.default_rng(2)
    items = decontaminate.build(list(range(300)), [prose(i, 20, 20) for i in range(300)])
    for _ in range(200):
        own = items.prints[rng.integers(300)].copy()
        flip = rng.choice(128, rng.integers(0, decontaminate.RADIUS + 1), replace=False)
        for b in flip:
            own[b // 8] ^= 1 << (b % 8)
        near = np.flatnonzero(np.bitwise_count(items.prints ^ own).sum(axis=1) <= decontaminate.RADIUS)
        entry, _ = decontaminate._lists(items.near[0], np.arange(decontaminate.BLOCKS) * 256 + own)
        assert set(near) <= set(items.near[1][entry].tolist())


def test_leak_edges(spark):
    items = spark.createDataFrame([(1, prose(1, 120)), (None, "one two"), (3, None)], "item_id long, text string").withColumns({c: F.lit(1) for c in ("id", "n", "key")})
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(edges(spark), items).collect()}
    assert got == {(1, 1), (5, 1), (10, 1), (8, None)}
    flags = edges(spark).select("doc_id", decontaminate.contaminated(F.col("text"), items).alias("f")).where("f").collect()
    assert {r.doc_id for r in flags} == {1, 5, 10, 8}
    assert decontaminate.leaks(edges(spark), empty(spark, "item_id long, text string")).count() == 0
    assert decontaminate.leaks(empty(spark), items).count() == 0


def brute_nearest(rows, queries, k):
    out = {}
    for q, u in queries:
        found = sorted((-float((u * v).sum() / np.sqrt((u * u).sum() * (v * v).sum())), i) for i, v in rows if i != q and len(u) == len(v))
        out[q] = [(i, pytest.approx(-s, abs=1e-12)) for s, i in found[:k]]
    return out


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 70)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 3)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 24))
    vectors[100:180] = vectors[100]  # many rows share a vector
    vectors[200:230] = vectors[50] + rng.normal(size=(30, 24)) * 1e-7
    rows = [(i, v.astype(np.float32).astype(float)) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    got = {}
    for r in sorted(nearest.nearest(frame, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, []),
            (8, [3e38, 3e38]), (9, [1e-300, 0.0]), (50, [1.0, 2.0, 3.0]), (100, None), (150, [0.0, 0.0]), (1, [1.0, 1.0]), (200, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(9))
    got = nearest.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 9), (0, 2, 1), (0, 3, 8), (0, 4, 200), (200, 1, 1), (200, 2, 8), (200, 3, 0), (200, 4, 9)]
    assert got[0].score == 1.0 and got[1].score == got[2].score == pytest.approx(0.5 ** 0.5)
    assert nearest.nearest(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_in_a_small_heap():
    """80 MB of vectors, all of them queries, in a local session of 512 MB."""
    code = """
from pyspark.sql import functions as F
from roverlake.llm import nearest
from roverlake.session import get_session
spark = get_session("local[2]", shuffle_partitions=2)
wide = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda n: (F.col("id") * n % 1009 - 500).cast("double"))
found = nearest.nearest(spark.range(10_000).select(F.col("id").alias("vec_id"), wide.alias("embedding")), F.lit(True)).collect()
print("FOUND", [(r.query_id, r["rank"], r.vec_id, r.score) for r in found])
"""
    root = str(Path(__file__).parents[2])
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root, "ROVERLAKE_DRIVER_MEMORY": "512m"}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    found = ast.literal_eval(run.stdout.rpartition("FOUND ")[2])
    # vectors repeat every 1,009 ids
    assert sorted(x[:3] for x in found) == [(q, rank, j) for q in range(10_000) for rank, j in enumerate([j for j in range(q % 1009, 10_000, 1009) if j != q][:5], 1)]
    assert all(x[3] == pytest.approx(1, abs=1e-12) for x in found)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_over_many_tiles(spark, monkeypatch, kind):
    """Small parts and blocks: lists merged over tiles and tasks, ids that repeat, equal vectors, two lengths."""
    for name, value in {"BLOCK_ROWS": 16, "QUERY_ROWS": 8, "HELD_ROWS": 32, "LEAST_ROWS": 4, "ROW_BYTES": 1, "STRIP": 3, "WIDE": 2, "RECOMPUTED": 200}.items():
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(9)
    vectors = [rng.normal(size=6 if n % 7 else 3).astype(np.float32).astype(float) for n in range(600)]
    for n in range(100, 220):
        vectors[n] = vectors[1] * 2.0 ** rng.integers(-3, 4)  # one direction
    rows = [(n if n < 500 else n % 40, v) for n, v in enumerate(vectors)]  # ids below 40 have several vectors
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], f"vec_id long, embedding array<{kind}>").repartition(5)
    want = {}
    for i, u in rows:
        if i % 2 == 0:
            best = want.setdefault(i, {})
            for j, v in rows:
                if j != i and len(u) == len(v):
                    best[j] = max(best.get(j, -2.0), float((u * v).sum() / np.sqrt((u * u).sum() * (v * v).sum())))
    got = {}
    for r in sorted(nearest.nearest(frame, F.col("vec_id") % 2 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {i: [(j, pytest.approx(s, abs=1e-12)) for j, s in sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]] for i, best in want.items()}
