"""Near-duplicate classes by BagMinHash (operator 7).

A document is the multiset of its five-word shingles. Each shingle starts
Poisson processes over the dyadic intervals of the discretised weights
(0,1], (1,2], (2,4], (4,8], ...; a point of an interval falls to a uniform unit
cell of it and counts if the shingle's weight reaches that cell. Every point
goes to a random signature component, which keeps the earliest point. Two
documents agree on a component with probability equal to their weighted
Jaccard similarity. Points later than a document's latest component are never
drawn, so that long documents cost about one point for each shingle.

Signatures are cut into bands; documents that share two bands are candidates
unless their sizes alone rule a link out, and each link is verified on the exact
multisets. Copies (equal multisets) fall together first by a 128-bit digest. A
bucket is not expanded into all pairs: its members are compared with the member
that collides most, and only members that are not
linked to the same centre are compared again, with a further centre where many
are left, and at last with each other, each candidate pair once however many
bands it shares. The classes are the connected components of all links.

Defined results: texts without a word (null and empty ones too) are classes of
their own; one of fewer than five words has the run of all its words as its
only shingle. Equal rows are one document; different texts of an id are compared
each for itself and are in one class with it (``text_classes`` keeps them apart). Rows
without id have one row with a null class. The class id is the smallest id of the class;
ids are below 2^62.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roverlake.llm.common import cut
from roverlake.llm.components import components
from roverlake.llm.text import GOLDEN, Words, mix, occurrence, pieces, seeded, uniform, word_shingles

SHINGLE = 5
THRESHOLD = 0.8
#: a pair at the threshold shares two bands or more with probability 0.999992
BANDS, ROWS, SHARED = 28, 4, 2
CENTRES, MANY = 4, 200
PIECE = 1 << 21
#: nodes from here on stand for further texts of an id
SPARE = 1 << 62


def bag_min_hash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """(docs, size) earliest points; doc, key, weight: distinct shingles with counts."""
    levels = 1 + int(np.ceil(np.log2(weight.max(initial=1))))
    owner, element, rate, low, top = [], [], [], [], []
    for j in range(levels):
        floor = 0 if j == 0 else 1 << (j - 1)
        has = weight > floor
        owner.append(doc[has])
        element.append(seeded(key[has], j))
        rate.append(np.full(has.sum(), float(max(1, floor))))
        low.append(np.full(has.sum(), float(floor)))
        top.append(weight[has].astype(np.float64))
    owner, element, rate, low, top = map(np.concatenate, (owner, element, rate, low, top))
    best = np.full((docs, size), np.inf)
    flat, time, drawn = best.ravel(), np.zeros(len(owner)), 0
    while len(owner):
        batch = int(np.clip(200_000 // len(owner), 1, 64))
        seeds = (np.arange(drawn, drawn + batch, dtype=np.uint64) + np.uint64(1)) * GOLDEN
        with np.errstate(over="ignore"):
            h = mix(element[:, None] + seeds)
        # summed point by point from the first, so that no bit depends on how many are drawn at once
        at = -np.log(uniform(h)) / rate[:, None]
        at[:, 0] += time
        np.cumsum(at, axis=1, out=at)
        h = mix(h + GOLDEN)
        part = (h % np.uint64(size)).astype(np.int64)
        if levels > 1:
            cell = low[:, None] + np.floor(uniform(mix(h + GOLDEN)) * rate[:, None])
            ok = (cell < top[:, None]) & (at < best.max(axis=1)[owner][:, None])
        else:
            ok = at < best.max(axis=1)[owner][:, None]
        np.minimum.at(flat, (owner[:, None] * size + part)[ok], at[ok])
        time, drawn = at[:, -1], drawn + batch
        live = time < best.max(axis=1)[owner]
        owner, element, rate, low, top, time = (x[live] for x in (owner, element, rate, low, top, time))
    return best


def _signed(batches):
    """(id, d1, d2, size, bands) of each text with a word; size: its shingles, repeats counted."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in pieces(texts, PIECE):
            words = Words(texts.slice(a, b - a))
            hashes, doc = word_shingles(words, SHINGLE)
            if not len(hashes):
                continue
            there, back = np.unique(doc, return_inverse=True)
            first = np.flatnonzero(np.concatenate([[True], back[1:] != back[:-1]]))
            with np.errstate(over="ignore"):
                d1, d2 = (np.add.reduceat(seeded(hashes, s), first).view(np.int64) for s in (101, 202))
            owner, key, count = occurrence(hashes, back)
            best = bag_min_hash(owner, key, count, len(there), BANDS * ROWS).view(np.uint64).reshape(len(there), BANDS, ROWS)
            code = np.tile(seeded(np.arange(BANDS, dtype=np.uint64), 7), (len(there), 1))
            with np.errstate(over="ignore"):
                for k in range(ROWS):
                    code = mix(code + best[:, :, k])
            bands = pa.ListArray.from_arrays(np.arange(0, code.size + 1, BANDS, dtype=np.int32), code.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(there)), pa.array(d1), pa.array(d2), pa.array(np.bincount(back)), bands], names=["id", "d1", "d2", "size", "bands"])


def _bags(batches):
    """(id, bag, small): each shingle's k-th occurrence as one element, so that the
    multiset similarity is that of these sets; small: their distinct 16-bit ends."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in pieces(texts, PIECE):
            words = Words(texts.slice(a, b - a))
            hashes, doc = word_shingles(words, SHINGLE)
            owner, key, count = occurrence(hashes, doc)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            with np.errstate(over="ignore"):
                bag = mix(np.repeat(key, count) + GOLDEN * nth.astype(np.uint64))
            edge = np.searchsorted(np.repeat(owner, count), np.arange(b - a + 1)).astype(np.int32)
            ends = np.unique(np.repeat(owner, count) << 16 | (bag & np.uint64(0xFFFF)).astype(np.int64))
            small = pa.ListArray.from_arrays(np.searchsorted(ends >> 16, np.arange(b - a + 1)).astype(np.int32), (ends & 0xFFFF).astype(np.uint16).view(np.int16))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(edge, bag.view(np.int64)), small], names=["id", "bag", "small"])


def _likely(x: str, y: str, threshold: float) -> Column:
    """Whether two signatures leave a link possible: sizes within the threshold of each
    other, and enough bands in common."""
    bands = F.size(F.filter(F.zip_with(f"{x}.bands", f"{y}.bands", lambda p, q: p == q), lambda same: same))
    return (F.least(f"{x}.size", f"{y}.size") >= threshold * F.greatest(f"{x}.size", f"{y}.size")) & (bands >= SHARED)


def _near(x: str, y: str, threshold: float) -> Column:
    """Whether the 16-bit ends of the elements leave a link possible. Of the shared
    elements, ends in common miss at most those that coincide with another in their
    own set, so that the test loses no link."""
    hidden = F.least(F.col(f"{x}.size") - F.size(f"{x}.small"), F.col(f"{y}.size") - F.size(f"{y}.small"))
    shared = F.size(F.array_intersect(f"{x}.small", f"{y}.small")) + hidden
    return shared * (1 + threshold) + 1e-6 >= threshold * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, ...) whose multiset similarity reaches the threshold."""
    left = bags.select(F.col("id").alias("a"), F.col("bag").alias("x"))
    right = bags.select(F.col("id").alias("b"), F.col("bag").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= threshold * (F.size("x") + F.size("y") - shared)).select(*pairs.columns)


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets whose members are not all linked to one document. ``root``
    is the most colliding document among a member and those linked to it, so equal
    roots are in one class."""
    known = [links.select(F.col(i).alias("id"), F.col(j).alias("root"), F.col(f"s{j}").alias("s")) for i in "ab" for j in "ab"]
    best = known[0].unionByName(known[1]).unionByName(known[2]).unionByName(known[3])
    best = best.groupBy("id").agg(F.max_by("root", F.struct("s", -F.col("root"))).alias("root"))
    rooted = members.select("key", "id", "score").join(best, "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    return rooted.join(split, "key", "left_semi")


def _centred(live: DataFrame, past: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pairs with their scores, centres): each bucket's most colliding member that no
    earlier centre is linked to, against the members that are not."""
    free = live if past is None else live.join(past.join(live.select("key", "id", "root"), ["key", "id"]).select("key", "root").distinct(), ["key", "root"], "left_anti")
    best = F.max_by(F.struct("id", "root", "score"), F.struct("score", -F.col("id")))
    centre = cut(free.groupBy("key").agg(best.alias("c")).select("key", "c.id", F.col("c.root").alias("rc"), F.col("c.score").alias("sc")))
    pairs = live.join(centre.withColumnRenamed("id", "c"), "key").where("root <> rc")
    pairs = pairs.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"), F.expr("if(id < c, score, sc) sa"), F.expr("if(id < c, sc, score) sb"))
    return pairs.distinct(), centre.select("key", "id")


def _rest(live: DataFrame, signs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) among members of different components, each in its
    first common band.

    An element that only one of the open documents holds is in no intersection.
    With r other elements left to each side, the similarity is at most
    min(r) / (sizes - min(r)); pairs that this rules out are not formed.
    """
    some = bags.join(live.select("id").distinct(), "id", "left_semi")
    lone = some.select("id", F.explode("bag").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    lone = lone.groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    able = signs.join(live.select("id").distinct(), "id", "left_semi").join(lone, "id", "left")
    able = able.withColumn("r", F.col("sign.size") - F.coalesce("lone", F.lit(0))).where(F.col("r") >= threshold * F.col("sign.size"))
    one = live.select("key", "id", "root").join(able, "id").select("key", F.col("id").alias("a"), F.col("root").alias("ra"), F.struct("sign.size", "sign.bands").alias("x"), F.col("r").alias("p"))
    two = one.toDF("key", "b", "rb", "y", "q")
    most = F.least("p", "q")
    able = most >= threshold * (F.col("x.size") + F.col("y.size") - most)
    first = F.filter(F.zip_with("x.bands", "y.bands", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull())[0]
    pairs = one.alias("o").join(two.alias("w"), (F.col("o.key") == F.col("w.key")) & (F.col("ra") < F.col("rb")) & able & (first == F.col("o.key")) & _likely("x", "y", threshold))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _numbered(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """Rows (id, t, node, text) of a table, null ids left out, and whether an id has several
    texts. ``t`` is a hash of the text; a text's node is its id, or, for all texts but
    one of such an id, a number above all ids."""
    rows = documents.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).cast("string").alias("text")).where("id is not null")
    several = rows.groupBy("id").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where("t0 < t1").select("id", "t0")
    if several.isEmpty():
        return rows.select("id", "t", F.col("id").alias("node"), "text"), False
    apart = F.xxhash64("id", "t").bitwiseAND(SPARE - 1).bitwiseOR(F.lit(SPARE))
    node = F.when(F.col("t0").isNull() | (F.col("t") == F.col("t0")), F.col("id")).otherwise(apart)
    return rows.join(several, "id", "left").select("id", "t", node.alias("node"), "text"), True


def text_classes(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, t, node, class_id) for each distinct id and text (``t`` is its xxhash64): a text
    whose node is its class_id stands for its class. Null ids have no row."""
    rows, _ = _numbered(documents, key, text)
    classes = _classes(rows.select(F.col("node").alias("id"), "text"), threshold)
    return rows.select("id", "t", "node").distinct().join(classes.withColumnRenamed("id", "node"), "node").select("id", "t", "node", "class_id")


def later_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that another stands for: their (id, t), or, where every id has one
    text, their ids alone, which need no join with the texts."""
    rows, several = _numbered(documents, key, text)
    classes = _classes(rows.select(F.col("node").alias("id"), "text"), threshold).where("id <> class_id")
    if not several:
        return classes.select("id")
    return rows.select("id", "t", "node").distinct().join(classes.select(F.col("id").alias("node")), "node").select("id", "t")


def near_classes(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, class_id) for each distinct id; the texts of an id are in one class with
    it, and with whatever one of them is linked to. Rows without id have a null class."""
    rows, several = _numbered(documents, key, text)
    classes = _classes(rows.select(F.col("node").alias("id"), "text"), threshold)
    if several:
        classes = cut(classes)
        of = rows.select("id", "node").distinct().join(classes.withColumnRenamed("id", "node"), "node")
        own = classes.withColumnRenamed("class_id", "own")
        united = components(of.where("node <> id").join(own, "id").select(F.col("class_id").alias("a"), F.col("own").alias("b")))
        classes = classes.where(F.col("id") < SPARE).join(united.withColumnRenamed("id", "class_id"), "class_id", "left")
        classes = classes.select("id", F.coalesce("root", "class_id").alias("class_id"))
    nameless = documents.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("class_id")).limit(1)
    return classes.unionByName(nameless)


def _classes(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, class_id) of rows (id, text) in which an id has one text."""
    signed = cut(rows.mapInArrow(_signed, "id long, d1 long, d2 long, size long, bands array<long>"))
    copies = signed.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = cut(signed.join(copies, ["d1", "d2"], "left").select("id", "rep", F.struct("size", "bands").alias("sign")))
    copied = marked.where("id <> rep").select("id", "rep")
    reps = marked.where("rep is null or id = rep").select("id", "sign").dropDuplicates(["id"])

    # buckets of two documents and more, each member with its number of collisions over all bands
    banded = reps.select("id", F.explode("sign.bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(banded.join(sizes, "key"))
    score = cut(members.groupBy("id").agg(F.sum("n").alias("score")))
    live = members.select("key", "id").join(score, "id").withColumn("root", F.col("id"))
    bags = cut(rows.join(score.select("id"), "id", "left_semi").mapInArrow(_bags, "id long, bag array<long>, small array<short>").dropDuplicates(["id"]))
    signs = cut(reps.join(bags.select("id", "small"), "id").select("id", F.struct("sign.size", "sign.bands", "small").alias("sign")))
    left, right = signs.select(F.col("id").alias("a"), F.col("sign").alias("x")), signs.select(F.col("id").alias("b"), F.col("sign").alias("y"))

    links, past = None, None
    for _ in range(CENTRES):
        pairs, centres = _centred(live, past)
        past = centres if past is None else past.unionByName(centres)
        pairs = pairs.join(left, "a").join(right, "b").where(_likely("x", "y", threshold) & _near("x", "y", threshold)).select("a", "b", "sa", "sb")
        found = cut(_verified(pairs, bags, threshold))
        links = found if links is None else cut(links.unionByName(found).distinct())
        live = cut(_open(live, links))
        # a further centre pays where many members of a bucket are still apart; results are the same without
        apart = live.groupBy("key").agg(F.count_distinct("root").alias("r"), F.count(F.lit(1)).alias("n"))
        left_over, of = apart.agg(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if left_over <= MANY * of:
            break
    if of:
        rest = cut(_rest(live, signs, bags, threshold)).join(left, "a").join(right, "b").where(_near("x", "y", threshold)).select("a", "b")
        links = links.select("a", "b").unionByName(_verified(rest, bags, threshold))
    roots = components(links)

    # copies follow their representative; every other id is a class of its own
    ids = rows.select("id").distinct()
    nodes = ids.join(copied, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    nodes = nodes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("rep"))
    return nodes.select("id", F.col("rep").alias("class_id")).distinct()
