"""Exact nearest neighbours by a block matrix join on int8 tiles (operator 2).

Query blocks meet candidate blocks in tiles. In a tile the unit vectors are
int8 codes with a scale each; the integer products give every cosine with a
bound on the quantisation error (from the exact norms of the residues). Each
query has a heap of the k best found so far, whose last score is its floor;
where that lets many pairs of a tile through, the tile's own k-th largest lower
bound does it. Only pairs whose upper bound reaches the floor are recomputed, in
double precision on the original vectors. The tasks' lists are merged by query.

A task holds one part of the queries (``HELD_ROWS``, ``HELD_BYTES``), streams
one part of the candidate blocks past it and returns k rows for each query. More
queries make more parts; the candidates are shuffled once, in at most
``MOST_PARTS`` parts and so few that the lists stay below the vectors in size.
The join is a product of partitions (``shuffle_replicate_nl``): it copies no
matches of a block into a list and broadcasts nothing, so neither an executor's
memory nor the driver's grows with the table, nor with a vector that many rows
share.

Defined results: a vector that is null, empty or zero, or holds a null, NaN or
infinite component, and a row without id, take no part; vectors are compared
with those of the same length only; equal scores are ordered by id; rows of the
same id are one item, whose score with another is the best of its vectors, and
no candidate of itself; fewer candidates than k are all returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roverlake.llm.common import parts

#: rows of a block of candidates and of queries, at most, and its bytes
BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES = 4096, 4096, 1 << 21
#: queries that a task holds, and their bytes (as doubles)
HELD_ROWS, HELD_BYTES = 1 << 15, 1 << 24
#: parts of the candidates, each of at least 8 blocks of LEAST_ROWS; a part returns k rows for each query, of so many bytes
MOST_PARTS, LEAST_ROWS, ROW_BYTES = 64, 256, 32
#: queries of a tile that are multiplied at once; pairs of a query above which the tile's own floor is found; components recomputed at once
STRIP, WIDE, RECOMPUTED = 256, 64, 1 << 21


def _quantised(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 codes (as floats), scales, norms of the coded vectors and of the residues."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    # sums of int8 products are exact in float32 up to 2^24, in float64 beyond
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return code.astype(kind), scale, np.sqrt((coded * coded).sum(axis=1)), np.sqrt(((unit - coded) ** 2).sum(axis=1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, divided by a power of two near their largest component, so
    that no square overflows or vanishes; cosines are the same to the last bit."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.ldexp(x, -np.frexp(top)[1])


class _Block:
    """Candidates of one length with their codes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.code, self.scale, self.norm, self.left = _quantised(_scaled(rows))
        self.repeats = int(np.unique(ids, return_counts=True)[1].max())


class _Asked(_Block):
    """Queries of one length with a heap each: (score, -id) of the k best items met."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        super().__init__(ids, rows)
        self.k, self.best = k, [[] for _ in ids]
        #: score and id of the heap's last item, once it holds k
        self.floor, self.last = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)

    def meet(self, at: int, item: int, score: float) -> None:
        top = self.best[at]
        same = next((n for n, x in enumerate(top) if x[1] == -item), None)
        if same is not None:
            if score <= top[same][0]:
                return
            top[same] = (score, -item)
            heapq.heapify(top)
        elif len(top) < self.k:
            heapq.heappush(top, (score, -item))
        else:
            heapq.heappushpop(top, (score, -item))
        if len(top) == self.k:
            self.floor[at], self.last[at] = top[0][0], -top[0][1]


def tile(asked: _Asked, block: _Block) -> None:
    """The block's candidates go into the heaps of the queries they are among the k nearest of."""
    # |u.v - su.sv| <= |su||ev| + |eu||sv| + |eu||ev|, and rounding (of the products with the scales in float32 too)
    slack = asked.norm * block.left.max() + asked.left * (block.norm + block.left).max() + 1e-6
    most = min(asked.k * block.repeats, len(block.ids))
    scale = block.scale.astype(block.code.dtype)
    for lo in range(0, len(asked.ids), STRIP):
        near = asked.code[lo:lo + STRIP] @ block.code.T
        near *= scale
        part = slice(lo, lo + STRIP)
        limit = ((asked.floor[part] - slack[part]) / asked.scale[part]).astype(near.dtype)
        rows = np.flatnonzero(near.max(axis=1) >= limit)
        if not len(rows):
            continue
        near, limit = near[rows], limit[rows]
        rows += lo
        through = near >= limit[:, None]
        wide = np.flatnonzero(np.count_nonzero(through, axis=1) > max(WIDE, most))
        if len(wide):
            others = near[wide]
            others[asked.ids[rows[wide]][:, None] == block.ids[None, :]] = -np.inf
            # among so many rows there are k different ids, even if ids repeat
            own = np.partition(others, others.shape[1] - most, axis=1)[:, others.shape[1] - most]
            own = own - (2 * slack[rows[wide]] / asked.scale[rows[wide]]).astype(near.dtype)
            through[wide] &= others >= own[:, None]
        q, c = np.divmod(np.flatnonzero(through), through.shape[1])
        near, q = near[q, c].astype(np.float64) * asked.scale[rows[q]], rows[q]
        err = asked.norm[q] * block.left[c] + asked.left[q] * (block.norm[c] + block.left[c]) + 1e-6
        fit = (near + err >= asked.floor[q]) & (asked.ids[q] != block.ids[c])
        q, c = q[fit], c[fit]
        step = max(1, RECOMPUTED // block.rows.shape[1])
        for first in range(0, len(q), step):
            at, other = q[first:first + step], c[first:first + step]
            a, b = _scaled(asked.rows[at]), _scaled(block.rows[other])
            score, ids = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)), block.ids[other]
            better = (score > asked.floor[at]) | ((score == asked.floor[at]) & (ids < asked.last[at])) | np.isneginf(asked.floor[at])
            for found in zip(at[better].tolist(), ids[better].tolist(), score[better].tolist(), strict=True):
                asked.meet(*found)


def _lists(held: Iterable[_Asked], k: int) -> dict[int, list[tuple[float, int]]]:
    """query id: the k best of its rows' heaps, as (-score, id)."""
    out: dict[int, dict[int, float]] = {}
    for asked in held:
        for query, top in zip(asked.ids.tolist(), asked.best, strict=True):
            items = out.setdefault(query, {})
            for score, item in top:
                items[-item] = max(score, items.get(-item, -np.inf))
    return {query: heapq.nsmallest(k, ((-s, j) for j, s in items.items())) for query, items in out.items()}


def _packed(rows: DataFrame, most: int, kind: str) -> DataFrame:
    """(dim, ids, rows, no): vectors of one length as numbered blocks of at most ``most``
    rows and ``BLOCK_BYTES``, formed where they lie."""

    def blocks(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat, off = vectors.flatten().to_numpy(zero_copy_only=False), np.asarray(vectors.offsets)
            off = off - off[0]
            size = np.diff(off)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                own, some = held.setdefault(dim, ([], []))
                own.append(ids[at])
                some.append(flat[off[at][:, None] + np.arange(dim)])
                full = max(1, min(most, BLOCK_BYTES // (8 * dim)))
                if sum(map(len, own)) >= full:
                    own, some = np.concatenate(own), np.concatenate(some)
                    whole = len(own) - len(own) % full
                    for lo in range(0, whole, full):
                        yield block(dim, own[lo:lo + full], some[lo:lo + full])
                    held[dim] = ([own[whole:]], [some[whole:]])
        for dim, (own, some) in held.items():
            if sum(map(len, own)):
                yield block(dim, np.concatenate(own), np.concatenate(some))

    def block(dim, ids, vectors):
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([vectors.astype(kind).tobytes()])], names=["dim", "ids", "rows"])

    return rows.select("id", "v").mapInArrow(blocks, "dim int, ids binary, rows binary").withColumn("no", F.monotonically_increasing_id())


def _sound(rows: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(id, v): the rows that take part."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each query."""
    spark = vectors.sparkSession
    kind, code = ("array<float>", "<f4") if vectors.select(vector).dtypes[0][1] == "array<float>" else ("array<double>", "<f8")
    asked, length = F.coalesce(is_query, F.lit(False)), F.greatest(F.size(vector), F.lit(0)).cast("long")
    size = vectors.select(asked.alias("q"), (8 * length).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("q").alias("queries"), F.sum(F.when(F.col("q"), F.col("n"))).alias("asked"), F.sum("n").alias("all")).first()
    held = max(1, -(-size["queries"] // HELD_ROWS), -(-(size["asked"] or 0) // HELD_BYTES))
    groups = max(1, min(parts(spark), MOST_PARTS, -(-size["rows"] // (8 * LEAST_ROWS)), (size["all"] or 0) // (ROW_BYTES * k * max(1, size["queries"]))))
    queries = _sound(vectors.where(is_query), key, vector, kind).repartition(max(1, -(-size["queries"] // QUERY_ROWS)))
    queries = _packed(queries, QUERY_ROWS, code).select("dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("no").alias("q_no")).repartition(held)
    blocks = _packed(_sound(vectors, key, vector, kind), min(BLOCK_ROWS, max(LEAST_ROWS, size["rows"] // (8 * groups))), code).repartition(groups)

    def tiles(batches):
        held: dict[int, _Asked] = {}
        met, block = None, None
        for batch in batches:
            dims, numbers, asked = (batch.column(c).to_pylist() for c in ("dim", "no", "q_no"))
            for at, (dim, no, q_no) in enumerate(zip(dims, numbers, asked, strict=True)):
                read = lambda c, of, batch=batch, at=at: np.frombuffer(batch.column(c)[at].as_buffer(), of)
                if no != met:
                    met, block = no, _Block(read("ids", "<i8"), read("rows", code).reshape(-1, dim))
                if q_no not in held:  # copied, else the whole batch would stay
                    held[q_no] = _Asked(read("q_ids", "<i8").copy(), read("q_rows", code).reshape(-1, dim).copy(), k)
                tile(held[q_no], block)
        found = [(query, item, -score) for query, top in _lists(held.values(), k).items() for score, item in top]
        for lo in range(0, len(found), 10_000):
            q, c, s = zip(*found[lo:lo + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    pairs = blocks.join(queries.hint("shuffle_replicate_nl"), "dim").select("dim", "no", "ids", "rows", "q_no", "q_ids", "q_rows")
    best = pairs.mapInArrow(tiles, "query_id long, vec_id long, score double")
    best = best.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
