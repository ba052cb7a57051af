"""The pipeline against the operators' brute-force versions, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from corpora import SF_SMALL, edges, prose
from oracle_compare import duck, rows_duck, rows_spark
from roverlake.llm.common import table
from roverlake.llm.queries import ORACLE, QUERIES
from test_models import brute_leaks
from test_pairs import brute_lines, classes_of


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").orderBy("doc_id").collect()]


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    known = stages["language_id"](spark, docs, SF_SMALL)
    assert known.columns == docs.columns and known.count() >= 0.99 * docs.count()
    before = texts(known)
    lines = stages["line_dedup"](spark, known, SF_SMALL)
    want = {i: t for i, t in brute_lines(before, 2).items() if t.strip() or not dict(before)[i].strip()}
    assert dict(texts(lines)) == want and lines.columns == docs.columns
    assert lines.where(F.col("n_chars") != F.length("text")).count() == known.where(F.col("n_chars") != F.length("text")).count()
    near = stages["near_dedup"](spark, lines, SF_SMALL)
    classes = classes_of(want.items())
    want = {i: t for i, t in want.items() if classes[i] == i}
    assert dict(texts(near)) == want
    clean = stages["decontamination"](spark, near, SF_SMALL)
    leaks = {i for i, _ in brute_leaks([(i, t) for i, t in want.items()], [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()])}
    assert dict(texts(clean)) == {i: t for i, t in want.items() if i not in leaks}
    packed = stages["packing"](spark, clean, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == len(want) - len(leaks & set(want))


def test_stages_take_edge_rows(spark):
    docs = edges(spark).withColumn("lang", F.lit("en"))
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() >= 1
    empty = edges(spark).where("false")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF_SMALL)
        assert empty.count() == 0


def test_near_stage_keeps_one_row_of_an_id(spark):
    kept = P.dedup_near(spark, edges(spark), SF_SMALL)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12] and ids.count(None) == 2


def test_near_stage_keeps_texts_of_their_own(spark):
    """Of an id with two texts, one a copy of another document, the other text stays."""
    rows = [(1, prose(1, 90)), (5, prose(1, 90)), (5, prose(2, 90)), (5, prose(2, 90)), (6, prose(3, 90)), (None, prose(1, 90))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(texts(P.dedup_near(spark, docs, SF_SMALL)), key=str) == sorted([(1, prose(1, 90)), (5, prose(2, 90)), (6, prose(3, 90)), (None, prose(1, 90))], key=str)


def test_run_returns_pieces(spark):
    got = P.run(spark, SF_SMALL)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_all_are_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert names == list(range(1, 14)) and {*QUERIES, "pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    cols, rows = rows_spark(QUERIES[name](spark, SF_SMALL))
    want, other = rows_duck(duck(SF_SMALL), ORACLE[name])
    assert cols == want and rows == other
