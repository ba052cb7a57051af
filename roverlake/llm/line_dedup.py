"""Line dedup over a suffix array of line ids (operator 6), in DataFrame functions only.

The sequence of a document is its non-blank lines, each identified by a 128-bit
hash of its trimmed text. Suffixes are ordered by distributed prefix doubling:
the rank of a suffix by its first k lines is the number of suffixes in lower
classes, and the rank by k + s lines comes from the pair of ranks at i and
i + s. Only suffixes that still share their rank are carried on; a suffix
alone in its class has no repeat. Doubling ends at the shortest run that
counts (``min_lines``), where equal ranks are the intervals of the suffix array
whose longest common prefix has at least that many lines. The earliest member of an
interval stays; overlapping and adjoining windows of later members are the maximal
repeated runs, and their lines are deleted.

A line is therefore deleted if it lies in a run of ``min_lines`` lines or more
that also occurs earlier, by document id and line.

Defined results: a null or empty text has no lines and stays as it is; a null id
comes before all others; rows of the same id and text are one document (each
gets the same answer); rows of the same id and different texts are ordered by a
hash of the text; blank lines are not compared and stay; a document whose
lines all go has an empty text. No document is dropped here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roverlake.llm.common import cut

MIN_LINES = 2
AT = ("id", "t", "i")
BLANK = " \t\r"


def _numbered(text: Column) -> Column:
    """Non-blank lines as (line number, two hashes)."""
    lines = F.transform(F.split(text, "\n"), lambda x, n: F.struct(n.alias("line"), F.trim(x, F.lit(BLANK)).alias("own")))
    kept = F.filter(lines, lambda x: x["own"] != "")
    return F.transform(kept, lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["own"]).alias("h1"), F.xxhash64(x["own"], F.lit(1)).alias("h2")))


def _ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """classes: distinct keys with their number of members n. Adds ``rank``: the
    number of members of all classes before, in the order of the keys."""
    dealt = cut(classes.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("s"))  # one row for each partition
    ahead = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(*keys)) - F.col("n")
    return dealt.withColumn("inside", inside).join(F.broadcast(ahead), "part").select(*keys, (F.col("inside") + F.col("ahead")).alias("rank"))


def later_windows(documents: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(id, t, i, line, last, source): windows of ``min_lines`` lines that occur
    earlier. i is the place among the document's non-blank lines, line and last are
    line numbers of the text, source is the earliest occurrence (id, t, i)."""
    docs = documents.select(F.col(key).alias("id"), F.xxhash64(text).alias("t"), _numbered(F.col(text)).alias("lines"))
    lines = docs.select("id", "t", F.posexplode("lines").alias("i", "x")).select(*AT, "x.line", "x.h1", "x.h2")
    classes = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    active = lines.join(_ranked(classes, ["h1", "h2"]), ["h1", "h2"])
    active = cut(active.select(*AT, "line", F.col("line").alias("last"), "rank").distinct())
    length = 1
    while length < min_lines:
        shift = min(length, min_lines - length)
        first, second = active.alias("a"), active.alias("b")
        follows = F.expr(f"a.id <=> b.id and a.t = b.t and a.i + {shift} = b.i")
        pairs = cut(first.join(second, follows).select(*(f"a.{c}" for c in AT), "a.line", "b.last", F.col("a.rank").alias("r1"), F.col("b.rank").alias("r2")))
        classes = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        active = cut(pairs.join(_ranked(classes, ["r1", "r2"]), ["r1", "r2"]).select(*AT, "line", "last", "rank"))
        length += shift
    earliest = active.groupBy("rank").agg(F.min(F.struct(*AT)).alias("source"))
    return active.join(earliest, "rank").where(F.struct(*AT) > F.col("source")).select(*AT, "line", "last", "source")


def repeated_runs(windows: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The maximal repeated runs of later copies: (id, t, i, n_lines, line, last,
    source), joined from windows of which each and its source follow the one before."""
    order = Window.partitionBy("id", "t").orderBy("i")
    goes_on = (
        (F.col("i") == F.lag("i").over(order) + 1)
        & F.col("source.id").eqNullSafe(F.lag("source.id").over(order))
        & (F.col("source.t") == F.lag("source.t").over(order))
        & (F.col("source.i") == F.lag("source.i").over(order) + 1)
    )
    marked = windows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(order)).groupBy("id", "t", "run")
    return runs.agg(
        F.min("i").alias("i"), (F.max("i") - F.min("i") + min_lines).alias("n_lines"),
        F.min("line").alias("line"), F.max("last").alias("last"), F.min("source").alias("source"),
    ).drop("run")


def dedup_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """The documents with the later copies of runs cut out of ``text``, blank lines
    inside a run too, and one more column: removed_lines (in place of any such)."""
    windows = later_windows(documents, key, text, min_lines)
    gone = windows.select("id", "t", F.explode(F.sequence("line", "last")).alias("line")).groupBy("id", "t").agg(F.collect_set("line").alias("gone"))
    # the lines go through the join in place of the text, so that each is reached by its number
    rest = [c for c in documents.columns if c not in (text, "removed_lines")]
    docs = documents.select(F.struct(*rest).alias("row"), F.col(key).alias("own_id"), F.xxhash64(text).alias("own_t"), F.split(text, "\n").alias("lines"))
    docs = docs.join(gone, docs["own_id"].eqNullSafe(gone["id"]) & (docs["own_t"] == gone["t"]), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(kept, lambda n: F.col("lines")[n]))
    out = {c: F.col("row")[c] for c in rest} | {text: F.array_join(left, "\n")}
    names = [c for c in documents.columns if c != "removed_lines"]
    return docs.select(*(out[c].alias(c) for c in names), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines"))
