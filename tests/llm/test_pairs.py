"""Near duplicates, components, line dedup and substring dedup against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpora import SF_SMALL, edges, empty, prose
from roverlake.llm import components, line_dedup, near_dedup, substring_dedup
from roverlake.llm.common import table


def bag(text):
    w = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", text.lower())
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes_of(docs):
    """Smallest id of each document's class, from all pairs."""
    bags = {i: bag(t or "") for i, t in docs}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in bags if bags[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            small, large = sorted((sum(bags[a].values()), sum(bags[b].values())))
            if small >= 0.8 * large and 1.8 * sum((bags[a] & bags[b]).values()) >= 0.8 * (small + large) - 1e-9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def edited(text, share, seed):
    rng = random.Random(seed)
    words = text.split(" ")
    for i in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = f"edit{rng.random():.6f}".replace(".", "")
    return " ".join(words)


def test_near_classes_equal_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    got = {r.id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert got == classes_of([(r.doc_id, r.text) for r in docs.collect()])


def test_near_classes_of_large_groups(spark):
    """Copies that resemble their source but hardly each other, and chains."""
    rows, n = [], 1000
    for group in range(3):
        base = prose(100 + group, 400, 400)
        rows += [(n + 10 * i + group, edited(base, 0.01 + 0.012 * (i % 3), 50 * group + i)) for i in range(40)]
        rows.append((5000 + group, base))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert got == classes_of(rows)


def test_near_classes_edges(spark):
    got = {r.id: r.class_id for r in near_dedup.near_classes(edges(spark)).collect()}
    assert got == {None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12}
    assert near_dedup.near_classes(empty(spark)).count() == 0


def test_bag_min_hash_is_unbiased():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    keys = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    size = 4096
    doc, key, weight = np.repeat([0, 1], 60), np.tile(keys, 2), np.concatenate([a, b])
    got = near_dedup.bag_min_hash(doc[weight > 0], key[weight > 0], weight[weight > 0], 2, size)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[0] == got[1]).mean() - exact) < 4 * np.sqrt(exact * (1 - exact) / size)


def test_signatures_do_not_depend_on_the_piece():
    """A text has the same band codes alone and within a full piece."""
    own = [prose(60 + n, n) for n in (6, 10, 20, 40, 80, 300)] + [" ".join(["again"] * 40)]
    rest = prose(77, 290_000, 400).split("\n")
    whole = pa.RecordBatch.from_pydict({"id": pa.array(range(len(own) + len(rest))), "text": own + rest})
    assert near_dedup.PIECE * 0.9 < sum(map(len, own + rest)) < near_dedup.PIECE
    together = {r["id"]: r for out in near_dedup._signed([whole]) for r in out.slice(0, len(own)).to_pylist()}
    for i, text in enumerate(own):
        alone = next(near_dedup._signed([pa.RecordBatch.from_pydict({"id": [i], "text": [text]})])).to_pylist()
        assert alone == [together[i]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges_ = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges_:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges_, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def brute_lines(rows, least):
    """Texts after line dedup: rows in order, windows of ``least`` non-blank lines seen before."""
    seen, out = set(), {}
    for i, text in rows:
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(full) - least + 1):
            window = tuple(lines[j].strip(" \t\r") for j in full[k:k + least])
            if window in seen:
                gone |= set(range(full[k], full[k + least - 1] + 1))
            seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_dedup_equals_brute_force(spark, least):
    rng = random.Random(least)
    lines = ["", " a", "b ", "c", "d", "e\t", "f"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 14)))) for i in range(60)] + [(70, None)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=least).collect()}
    assert got == brute_lines(rows, least)


def test_line_dedup_edges(spark):
    out = line_dedup.dedup_lines(edges(spark))
    assert out.columns.count("removed_lines") == 1 and out.count() == 15
    rows = sorted(((r.doc_id, r.removed_lines) for r in out.select("doc_id", "removed_lines").collect() if r.doc_id is not None))
    assert [r for r in rows if r[0] in (1, 2, 3, 4)] == [(1, 0), (2, 0), (3, 0), (4, 0)]
    assert [n for i, n in rows if i == 5] == [10, 10] and dict(rows)[9] == 39 and dict(rows)[10] == 10
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_runs_are_maximal(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny\na\nb")]
    windows = line_dedup.later_windows(spark.createDataFrame(rows, "doc_id long, text string"))
    runs = line_dedup.repeated_runs(windows).collect()
    assert sorted((r.id, r.line, r["last"], r.n_lines, r.source.id, r.source.i) for r in runs) == [(2, 1, 3, 3, 1, 1), (2, 5, 6, 2, 1, 0)]


def test_line_dedup_is_native(spark):
    plan = line_dedup.dedup_lines(table(spark, SF_SMALL, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_substrings_find_every_passage(spark):
    """Passages of over 50 words at any place of other texts; each later copy is found."""
    rng = random.Random(5)
    passages = [" ".join(prose(900 + k, 51 + k, 500).split()) for k in range(20)]
    rows, holders = [], defaultdict(list)
    for i in range(120):
        own = prose(2000 + i, 150, 150).split(" ")
        if i % 3:
            k = rng.randrange(len(passages))
            at = rng.randrange(len(own))
            own[at:at] = [passages[k]]
            holders[k].append(i)
        rows.append((i, " ".join(own)))
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    later = {i for ids in holders.values() for i in ids[1:]}
    assert {r.id for r in got} == later
    texts = dict(rows)
    for r in got:
        span = texts[r.id][r.start:r.start + r.length]
        assert len(span.split()) == r.n_words and any(span in p for p in passages)
        assert texts[r.source_id][r.source_start:].startswith(span.split()[0])


def test_substrings_cut_out(spark):
    base, other = prose(31, 200, 10), prose(32, 60, 10)
    docs = spark.createDataFrame([(1, base, "k"), (2, other + " " + base, "k"), (3, base, "k")], "doc_id long, text string, own string")
    out = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(docs).collect()}
    assert out[1] == base and len(out[2]) < len(other) + 150 and out[2].startswith(other[:len(other) - 60]) and out[3].strip() == ""


def test_substrings_edges(spark):
    got = substring_dedup.repeated_spans(edges(spark))
    ids = {r.id for r in got.collect()}
    assert {5, 9, 10} <= ids and not ids & {1, 2, 3, 4, 8, 11, 12}
    out = substring_dedup.dedup_substrings(edges(spark))
    assert out.columns == edges(spark).columns and out.count() == 15
    assert out.where(F.col("doc_id") == 11).first().text.startswith("Ünï çödé")
    assert substring_dedup.repeated_spans(empty(spark)).count() == 0


def test_texts_of_one_id(spark):
    """An id's texts are one class with all that they are linked to; null ids have a null class."""
    a, b, c = prose(301, 60), prose(302, 60), prose(303, 60)
    frame = spark.createDataFrame([(1, a), (5, a), (2, b), (5, b), (7, c), (7, None), (None, a), (None, c), (9, c + " more")], "doc_id long, text string")
    got = sorted((r.id, r.class_id) for r in near_dedup.near_classes(frame).collect() if r.id is not None)
    assert got == [(1, 1), (2, 1), (5, 1), (7, 7), (9, 7)]
    assert [tuple(r) for r in near_dedup.near_classes(frame).where("id is null").collect()] == [(None, None)]
    stands = {(r.id, r.node == r.class_id) for r in near_dedup.text_classes(frame).collect()}
    assert (5, True) not in stands and {(7, True), (1, True), (2, True), (9, False)} <= stands
