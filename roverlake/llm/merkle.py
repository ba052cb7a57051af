"""A Merkle manifest of a dataset and proofs climbed by a recursive query (operator 13).

A leaf is the SHA-256 of a row's columns, each with its byte count. The leaves of
a language, by id, are hashed in runs of two, level by level, to a subroot, and the
subroots in language order to the root. Levels are built in blocks of ``2^HOP``
neighbours (a bounded group each), so a tree of n leaves takes log(n) / HOP
shuffles. What is stored is one row for each leaf and each block root: its digest,
its siblings on the ``HOP`` levels above, and the link to the row of its parent
block; the last block of a language links to the tree of subroots.

``climb`` is one recursive query over those rows: from each leaf, with the hash of
the row as it is found now, it joins the parent row, appends its siblings and
folds the hash through them until the root is passed. Only leaf rows grow with the
documents; parent rows are a 2^HOP-th of them, spread over salts, so that
no row of the upper levels is met in one task by all leaves below it.

Defined results: a null column enters a leaf as ``-``; rows of the same id are
ordered by their leaf, equal rows take neighbouring places; a null id comes first
and is not tampered with; a null language is a tree of its own, the first; very
long texts are hashed whole, and only digests are shuffled; an empty table has
no leaf and gives no row. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roverlake.llm.common import cut, new_folder

#: levels that one stored link climbs; a block of 2^HOP digests is one group
HOP = 10
#: copies of a parent row among which the leaves below it are dealt
SALTS = 64
#: the columns of a leaf, in order
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
#: tree numbers: languages count from 0
TOP, DONE = -1, -2
TAG = "struct<doc_id: long, found: binary>"
#: block rows up to this size in all are broadcast; more are joined by their salted keys
BROADCAST_BYTES = 32 << 20
BLOCK_BYTES = 48 * HOP + 200

#: a digest folded through the siblings of ``pos``: bit k of pos says on which side it stands on level k
FOLD = """aggregate(transform({siblings}, (s, k) -> struct(s AS s, k AS k)), {start}, (h, x) -> unhex(sha2(
    if(shiftright({pos}, x.k) % 2 = 1, concat(lower(hex(x.s)), lower(hex(h))), concat(lower(hex(h)), coalesce(lower(hex(x.s)), ''))), 256)))"""
CLIMB = """
WITH RECURSIVE climb (doc_id, leaf, salt, tree, stage, pos, proof, folded, subroot) AS (
    SELECT tag.doc_id, digest, pos % {salts}, up_tree, up_stage, up_pos, tied, {leaf_fold}, CAST(NULL AS BINARY) FROM {leaves}
    UNION ALL
    SELECT /*+ {hint}(b) */ c.doc_id, c.leaf, c.salt, b.up_tree, b.up_stage, b.up_pos, concat(c.proof, b.tied), {block_fold},
           coalesce(c.subroot, if(b.tree = -1 AND b.stage = 0, b.digest, NULL))
    FROM climb c JOIN {blocks} b ON b.tree = c.tree AND b.stage = c.stage AND b.pos = c.pos AND b.salt = c.salt
)
SELECT doc_id, leaf, subroot, proof, folded FROM climb WHERE tree = -2
"""


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 (binary) of a row."""
    return F.unhex(F.sha2(F.concat(*(_field(columns[c]) for c in LEAF)), 256))


def _joined(left: Column, right: Column) -> Column:
    """Digest of a run; a digest without sibling is hashed alone."""
    hexed = F.concat(F.lower(F.hex(left)), F.coalesce(F.lower(F.hex(right)), F.lit("")))
    return F.unhex(F.sha2(hexed, 256))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``tree``, the number of the row's group in the groups' order, ``pos``, the
    row's place in its group, and ``n``, the group's size. Rows are dealt by ranges and
    only counts for each (group, range) are added up, so a group of any size is spread
    over tasks."""
    dealt = cut(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    runs = cut(dealt.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_run")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")))
    # groups are numbered by the range in which they start, then inside it
    starts = runs.groupBy("_group").agg(F.min("_first").alias("_start")).withColumn("_in", F.shiftright("_start", 33))
    ranges = starts.groupBy("_in").agg(F.count(F.lit(1)).alias("_k"))  # one row for each range
    ranges = ranges.select("_in", (F.sum("_k").over(Window.orderBy("_in")) - F.col("_k")).alias("_before"))
    starts = starts.withColumn("_nth", F.row_number().over(Window.partitionBy("_in").orderBy("_start"))).join(ranges, "_in")
    groups = starts.select(F.col("_group").alias("_of"), (F.col("_before") + F.col("_nth") - 1).alias("tree"))
    same = Window.partitionBy("_group")
    runs = runs.withColumns({"_ahead": F.sum("_n").over(same.orderBy("_run")) - F.col("_n"), "n": F.sum("_n").over(same)})
    runs = runs.join(groups, runs["_group"].eqNullSafe(groups["_of"])).drop("_of")
    met = dealt.join(runs, dealt[group].eqNullSafe(runs["_group"]) & (dealt["_part"] == runs["_run"]))
    return met.select(*rows.columns, "tree", (F.col("_at") - F.col("_first") + F.col("_ahead")).alias("pos"), "n")


def _levels(base: Column, height: Column) -> Column:
    """The block's digests level by level: an array of arrays, ``base`` first."""
    def above(levels: Column, _: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(F.element_at(levels, -1)) - 1) / 2).cast("int"))
        return F.concat(levels, F.array(F.transform(runs, lambda i: _joined(F.get(F.element_at(levels, -1), i * 2), F.get(F.element_at(levels, -1), i * 2 + 1)))))

    return F.reduce(F.filter(F.sequence(F.lit(1), F.lit(HOP)), lambda k: k <= height), F.array(base), above)


def _linked(nodes: DataFrame, stage: int) -> DataFrame:
    """Nodes (tree, pos, digest, n, tag) of one stage as stored rows: their siblings
    up to the block's root, that root (in the block's first row) and the link."""
    width = 1 << HOP
    blocks = nodes.groupBy("tree", F.shiftright("pos", HOP).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "tag"))).alias("own"), F.first("n").alias("n"))
    height = F.when(F.col("n") > width, HOP).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    blocks = blocks.withColumn("height", height)
    blocks = blocks.withColumn("levels", _levels(F.transform("own", lambda x: x["digest"]), F.col("height")))
    steps = F.filter(F.sequence(F.lit(0), F.lit(HOP - 1)), lambda k: k < F.col("height"))

    def row(node: Column, i: Column) -> Column:
        def sibling(k: Column) -> Column:
            at = F.floor(i / F.pow(F.lit(2), k)).cast("int")
            return F.get(F.get(F.col("levels"), k), F.when(at % 2 == 1, at - 1).otherwise(at + 1))

        return F.struct(
            node["pos"].alias("pos"), node["digest"].alias("digest"), node["tag"].alias("tag"), F.transform(steps, sibling).alias("siblings"),
            F.when(i == 0, F.get(F.element_at("levels", -1), F.lit(0))).alias("top"))

    rows = blocks.select("tree", "block", "n", F.explode(F.transform("own", row)).alias("x"))
    goes_on = F.col("n") > width
    top_tree = F.col("tree") == TOP
    return rows.select(
        "tree", F.lit(stage).alias("stage"), "x.*", "n",
        F.when(goes_on, F.col("tree")).when(top_tree, DONE).otherwise(TOP).cast("long").alias("up_tree"),
        F.when(goes_on, stage + 1).otherwise(0).alias("up_stage"),
        F.when(goes_on, F.col("block")).when(top_tree, 0).otherwise(F.col("tree")).cast("long").alias("up_pos"))


@dataclass
class Manifest:
    """Where the rows are stored, the number of block rows, and the root's digest."""

    leaves: str
    blocks: list[str]
    n_blocks: int
    root: bytes | None


def _rise(nodes: DataFrame, folder: str) -> tuple[list[str], DataFrame]:
    """Writes the rows of ``nodes`` and of all blocks above them, a stage at a time.
    Returns the paths, and the root of each tree (up_pos, digest)."""
    spark, paths, ended = nodes.sparkSession, [], []
    while True:
        paths.append(f"{folder}/{len(paths)}")
        _linked(nodes, len(paths) - 1).write.parquet(paths[-1])
        heads = spark.read.parquet(paths[-1]).where("top is not null")
        ended.append(heads.where("up_tree <> tree").select("up_pos", F.col("top").alias("digest")))
        heads = heads.where("up_tree = tree")
        if heads.isEmpty():
            return paths, reduce(DataFrame.unionByName, ended)
        nodes = heads.select("tree", F.col("up_pos").alias("pos"), F.col("top").alias("digest"), F.ceil(F.col("n") / (1 << HOP)).alias("n"), F.lit(None).cast(TAG).alias("tag"))


def build(documents: DataFrame) -> Manifest:
    """The manifest of rows (doc_id, lang, digest, found), written to the shared folder.
    ``digest`` makes the tree; ``found``, the digest of the row as a later check finds it,
    is only kept beside it."""
    spark, folder = documents.sparkSession, new_folder(documents.sparkSession, "merkle")
    leaves = cut(documents.select("doc_id", "lang", "digest", "found", F.monotonically_increasing_id().alias("row")))
    own = placed(leaves, "lang", ["doc_id", "digest", "row"])
    nodes = own.select("tree", "pos", "digest", "n", F.struct("doc_id", "found").alias("tag"))
    paths, subroots = _rise(nodes, f"{folder}/leaves")
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("up_pos").alias("pos"), "digest", F.lit(subroots.count()).alias("n"), F.lit(None).cast(TAG).alias("tag"))
    above, root = _rise(top, f"{folder}/top")
    blocks = [*paths[1:], *above]
    found = root.first()  # one row
    return Manifest(paths[0], blocks, spark.read.parquet(*blocks).count(), found and bytes(found["digest"]))


def climb(spark: SparkSession, manifest: Manifest, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, leaf, subroot, proof (all siblings joined) and folded (all binary) for
    each leaf, by one recursive query that ascends a block with each step."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the default stops at a million rows
    tied = F.unhex(F.array_join(F.transform("siblings", lambda s: F.coalesce(F.hex(s), F.lit(""))), ""))
    leaves = spark.read.parquet(manifest.leaves).withColumn("tied", tied)
    blocks = spark.read.parquet(*manifest.blocks).withColumn("tied", tied)
    small = manifest.n_blocks * BLOCK_BYTES <= broadcast_bytes
    salts = 1 if small else SALTS
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spark.sql(CLIMB.format(hint="BROADCAST" if small else "MERGE", salts=salts, leaf_fold=FOLD.format(start="tag.found", pos="pos", siblings="siblings"),
                                  block_fold=FOLD.format(start="c.folded", pos="b.pos", siblings="b.siblings"), leaves="{leaves}", blocks="{blocks}"), leaves=leaves, blocks=blocks)


def manifest_of(documents: DataFrame, tampered: Column) -> DataFrame:
    """The result for a table of documents of which the rows with ``tampered`` are
    found with another n_chars (one more) than the manifest was built with."""
    columns = {c: F.col(c) for c in LEAF}
    changed = leaf_digest(columns | {"n_chars": F.col("n_chars") + 1})
    digest = leaf_digest(columns)
    rows = documents.select("doc_id", "lang", digest.alias("digest"), F.when(F.coalesce(tampered, F.lit(False)), changed).otherwise(digest).alias("found"))
    manifest = build(rows)
    root = F.lit(manifest.root and manifest.root.hex()).cast("string")
    climbed = climb(documents.sparkSession, manifest)
    return climbed.select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"),
        (F.lower(F.hex("folded")) == root).alias("verified"))
