"""Per-key running computations that stay parallel under key skew.

A plain ``Window.partitionBy(key).orderBy(t)`` sends each key's whole
history to one task; a robot or node holding a third of all rows would then
sort and scan a third of the data in a single task. The functions here split
each key's history into time chunks and scan in two levels:

1. within ``(key, chunk)``: a windowed running value (parallel across chunks);
2. per chunk: one summary row (partial aggregate), then a running value over
   the chunk summaries of each key (tiny: one row per key and chunk), shifted
   by one chunk to give the carry-in;
3. join the carry-in back on ``(key, chunk)`` -- the big side is already
   hash-partitioned on exactly these columns by step 1, so only the small
   summary side moves (AQE broadcasts it when it is small).

Supported running values are the ones the operators need: inclusive running
sums, last non-null value ("forward fill"), and next-row value ("lead").

The chunk must not decrease along the order: a bucket of the ordering column
itself (``chunk_of`` for a time, ``chunk_of_seq`` for a sequence number).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roverlake.functions.time import parse_width

DEFAULT_CHUNK = "1 hour"
CHUNK_ROWS = 100_000


# Rows without a time form a chunk before all others, as NULLs sort first.
NO_TIME = -(1 << 62)


def chunk_of(time_col: str, width: str = DEFAULT_CHUNK) -> Column:
    """Chunk number of a row: its time bucket (epoch aligned). Plain arithmetic
    rather than ``window()``, which would filter out rows without a time."""
    n, unit = parse_width(width)
    if unit != "seconds":
        raise ValueError(f"chunk width {width!r} has no fixed length")
    us = F.unix_micros(F.col(time_col).cast("timestamp"))
    return F.coalesce(F.floor(us / F.lit(n * 1_000_000)).cast("long"), F.lit(NO_TIME))


def chunk_of_seq(seq_col: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number by sequence number, for logs ordered by it."""
    return F.coalesce(F.floor(F.col(seq_col) / F.lit(rows)).cast("long"), F.lit(NO_TIME))


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def running(
    df: DataFrame,
    key: Sequence[str] | str,
    order: Sequence[str],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds inclusive running sums and last-non-null values per key.

    ``sums``: output name -> numeric expression; the output is the sum over
    all rows of the key up to and including this one (in ``order``).
    ``lasts``: output name -> expression; the output is its last non-null
    value up to and including this row (NULL before the first one).
    """
    keys = [key] if isinstance(key, str) else list(key)
    sums, lasts = sums or {}, lasts or {}
    chunk_col, keep_chunk = _chunk_column(chunk)
    staged = (df if keep_chunk else df.withColumn(chunk_col, chunk)).withColumns(
        {f"_s_{n}": e for n, e in sums.items()} | {f"_l_{n}": e for n, e in lasts.items()}
    )
    ordering = [F.col(c) for c in order]
    w_local = Window.partitionBy(*keys, chunk_col).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumns(
        {f"_ls_{n}": F.sum(f"_s_{n}").over(w_local) for n in sums}
        | {f"_ll_{n}": F.last(f"_l_{n}", ignorenulls=True).over(w_local) for n in lasts}
    )

    ostruct = _order_struct(order)
    aggs = [F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums] + [
        F.max_by(F.col(f"_l_{n}"), F.when(F.col(f"_l_{n}").isNotNull(), ostruct)).alias(f"_t_{n}") for n in lasts
    ]
    # Summaries are partial aggregates of the input itself (one row per key,
    # chunk and map task crosses the network). Deriving them from the windowed
    # rows instead would make Spark recompute the scan, shuffle and window in
    # the summary branch.
    summary = staged.groupBy(*keys, chunk_col).agg(*aggs)
    w_chunks = Window.partitionBy(*keys).orderBy(chunk_col).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, chunk_col,
        *[F.sum(f"_t_{n}").over(w_chunks).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(w_chunks).alias(f"_c_{n}") for n in lasts],
    )
    joined = local.join(carry, [*keys, chunk_col], "left")
    out = joined.withColumns(
        {n: F.col(f"_ls_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
        | {n: F.coalesce(F.col(f"_ll_{n}"), F.col(f"_c_{n}")) for n in lasts}
    )
    drop = ([] if keep_chunk else [chunk_col]) + [f"_{p}_{n}" for n in sums for p in ("s", "ls", "c")] + [
        f"_{p}_{n}" for n in lasts for p in ("l", "ll", "c")
    ]
    return out.drop(*drop)


def _chunk_column(chunk: Column | str) -> tuple[str, bool]:
    """A column name refers to a chunk column the caller already added (and
    keeps, so consecutive scans share one partitioning); a Column expression
    is added here and dropped afterwards."""
    if isinstance(chunk, str):
        return chunk, True
    return "_chunk", False


def next_value(
    df: DataFrame,
    key: Sequence[str] | str,
    order: Sequence[str],
    chunk: Column,
    value: str,
    out: str,
) -> DataFrame:
    """Adds ``out`` = ``value`` of the next row of the same key (lead), NULL
    on the key's last row. The last row of a chunk takes the first value of
    the next non-empty chunk."""
    keys = [key] if isinstance(key, str) else list(key)
    chunk_col, keep_chunk = _chunk_column(chunk)
    staged = df if keep_chunk else df.withColumn(chunk_col, chunk)
    w_local = Window.partitionBy(*keys, chunk_col).orderBy(*[F.col(c) for c in order])
    local = staged.withColumn("_lead", F.lead(F.col(value)).over(w_local))
    firsts = staged.groupBy(*keys, chunk_col).agg(F.min_by(F.col(value), _order_struct(order)).alias("_first"))
    w_chunks = Window.partitionBy(*keys).orderBy(chunk_col)
    nxt = firsts.select(*keys, chunk_col, F.lead("_first").over(w_chunks).alias("_next_chunk_first"))
    return (
        local.join(nxt, [*keys, chunk_col], "left")
        .withColumn(out, F.coalesce(F.col("_lead"), F.col("_next_chunk_first")))
        .drop(*(["_lead", "_next_chunk_first"] + ([] if keep_chunk else [chunk_col])))
    )
