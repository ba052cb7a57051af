"""Packing token sequences by non-negative least squares (operator 5).

A document of n ids fills n // window sequences alone; what remains is shorter
than the window. Of those remainders only the histogram of lengths (at most
``window`` numbers) comes to the driver, whatever the corpus: shallow
combinations of lengths that fill the window are enumerated, their repeat
counts are the non-negative least-squares solution against the histogram,
rounded, and what is left over is packed greedily, the longest first and the
best fit next. The plan says, for each length, which ranks go to which
sequences; Spark numbers the documents of each length and looks them up.

Defined results: a null text is an empty one (its end id alone); a document of
a whole number of windows has no remainder; repeated rows are packed as
documents of their own; an empty table gives no piece.
"""

from __future__ import annotations

from dataclasses import dataclass
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roverlake.llm.common import cut
from roverlake.llm.tokens import encoded

#: at most so many unused ids in a combination, and so many combinations
SLACK = 16
MAX_COMBINATIONS = 60_000
BUCKETS = 256
#: shares of the least-squares counts that are tried
ROUNDINGS = (1.0, 0.75, 0.5, 0.25, 0.0)


def _largest(present: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The largest present length that is at most ``most``; 0 if there is none."""
    at = np.searchsorted(present, most, side="right") - 1
    return np.where(at >= 0, present[np.maximum(at, 0)], 0)


def combinations(hist: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Shallow combinations that fill the window: up to three lengths each with the
    times it is taken, as arrays (combination, 3)."""
    present = np.flatnonzero(hist)
    found = []

    def add(*parts: np.ndarray) -> None:
        """parts: lengths and times in turn."""
        rows = np.zeros((len(parts[0]), 6), np.int64)
        for k, part in enumerate(parts):
            rows[:, k] = part
        total = (rows[:, 0::2] * rows[:, 1::2]).sum(axis=1)
        found.append(rows[(total <= window) & (total >= window - SLACK) & (rows[:, 0] > 0)])

    if not len(present):
        return np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)
    one = np.ones(len(present), np.int64)
    add(present, one)
    rest = _largest(present, window - present)
    add(present, one, rest, (rest > 0) * one)
    for times in range(2, 33):  # several of one length and one that fills up
        some = present[present * times <= window]
        rest = _largest(present, window - some * times)
        add(some, np.full(len(some), times), rest, (rest > 0).astype(np.int64))
    room = MAX_COMBINATIONS - sum(map(len, found))
    thirds = present[np.unique(np.linspace(0, len(present) - 1, max(1, min(len(present), room // max(1, len(present)))), dtype=np.int64))]
    a, b = (x.ravel() for x in np.meshgrid(present, thirds))
    keep = (a + b < window) & (a >= b)
    a, b = a[keep], b[keep]
    rest = _largest(present, window - a - b)
    keep = rest > 0
    add(a[keep], np.ones(keep.sum(), np.int64), b[keep], np.ones(keep.sum(), np.int64), rest[keep], np.ones(keep.sum(), np.int64))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[:, 0::2], rows[:, 1::2]


def least_squares(lengths: np.ndarray, times: np.ndarray, hist: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative repeat counts x that bring the lengths used near the histogram:
    multiplicative updates of min |A x - h|, where A[l, c] is how often c takes l."""
    size = len(hist)
    target = (times * hist[lengths]).sum(axis=1).astype(np.float64)
    share = np.bincount(lengths.ravel(), times.ravel(), size)
    x = np.where(times > 0, hist[lengths] / np.maximum(share[lengths], 1), np.inf).min(axis=1, initial=np.inf)
    x = np.where(np.isfinite(x), x, 0.0)
    for _ in range(rounds):
        used = np.bincount(lengths.ravel(), (times * x[:, None]).ravel(), size)
        x *= target / np.maximum((times * used[lengths]).sum(axis=1), 1e-12)
    return x


@dataclass
class Plan:
    """Runs sorted by (length, rank): documents of ``length`` from rank ``low`` on go,
    ``each`` to a sequence, to sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    low: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(hist: np.ndarray, window: int) -> Plan:
    """hist[l]: documents of length l, l < window."""
    lengths, times = combinations(hist, window)
    x = least_squares(lengths, times, hist) if len(lengths) else np.empty(0)
    # of several roundings the one with the fewest sequences
    chosen = min((_rounded(lengths, times, x * part, hist, window) for part in ROUNDINGS), key=lambda found: sum(repeat for _, repeat in found))
    rows, sequence, rank = [], 0, np.zeros(window + 1, np.int64)
    for parts, repeat in chosen:
        offset = 0
        for l, t in parts:
            rows.append((l, int(rank[l]), t, sequence, offset))
            rank[l] += t * repeat
            offset += l * t
        sequence += repeat
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(table[:, k]) for k in range(5)), sequence)


def _rounded(lengths: np.ndarray, times: np.ndarray, x: np.ndarray, hist: np.ndarray, window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Rounded repeat counts, the largest first and as far as documents are left, then
    the rest greedily: [([(length, times)], repeats)]."""
    left = hist.astype(np.int64).copy()
    chosen = []
    for c in np.argsort(-x, kind="stable"):
        repeat = int(x[c] + 0.5)
        if not repeat:
            break
        parts: dict[int, int] = {}
        for l, t in zip(lengths[c].tolist(), times[c].tolist(), strict=True):
            if t:
                parts[l] = parts.get(l, 0) + t
        repeat = min(repeat, *(int(left[l]) // t for l, t in parts.items()))
        if repeat:
            chosen.append((sorted(parts.items(), reverse=True), repeat))
            for l, t in parts.items():
                left[l] -= t * repeat
    return chosen + _greedy(left, window)


def _greedy(left: np.ndarray, window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over what is left of the histogram."""
    below = list(range(len(left)))  # below[l]: a length not above l that may be left

    def find(l: int) -> int:
        path = []
        while l > 0 and not left[l]:
            path.append(l)
            l = below[l] if below[l] < l else l - 1
        for p in path:
            below[p] = l
        return l

    out = []
    while longest := find(len(left) - 1):
        parts: list[tuple[int, int]] = []
        room, most = window, longest
        while room > 0 and (l := find(min(most, room))):
            t = min(int(left[l]), room // l)
            parts.append((l, t))
            room -= l * t
            most = l - 1
        repeat = min(int(left[l]) // t for l, t in parts)
        for l, t in parts:
            left[l] -= t * repeat
        out.append((parts, repeat))
    return out


def cut_pieces(documents: DataFrame, path: str, end: int, window: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its number of ids, the checksums of its whole windows, and
    length and checksum of its remainder."""

    def count(batches):
        for batch in batches:
            for a, b, ids, sizes in encoded(path, batch.column(1), end):
                edge = np.concatenate([[0], np.cumsum(sizes)])
                raw = memoryview(ids.astype("<u4").tobytes())
                full, last = [], []
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    mid = hi - (hi - lo) % window
                    full.append([zlib.crc32(raw[4 * k:4 * (k + window)]) for k in range(lo, mid, window)])
                    last.append(zlib.crc32(raw[4 * mid:4 * hi]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(full, pa.list_(pa.int64())), pa.array(sizes % window), pa.array(last, pa.int64())],
                    names=["id", "doc_tokens", "full", "rest", "rest_crc"],
                )

    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "id long, doc_tokens long, full array<long>, rest long, rest_crc long")


def pack(documents: DataFrame, path: str, end: int = 2, window: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    docs = cut(cut_pieces(documents, path, end, window, key, text))
    hist = np.zeros(window, np.int64)
    for r in docs.groupBy("rest").count().collect():  # at most ``window`` rows
        hist[r["rest"]] = r["count"]
    hist[0] = 0
    made = plan(hist, window)
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("id", "rest_crc"), F.lit(BUCKETS)))

    # rank among the documents of the same length: place in the bucket plus the buckets before
    sizes = docs.where("rest > 0").groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("rest", "bucket", (F.sum("n").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("id", "rest_crc"))
    ranked = docs.where("rest > 0").select("id", "doc_tokens", "rest", "rest_crc", "bucket", place.alias("place"))
    ranked = ranked.join(before, ["rest", "bucket"]).withColumn("rank", F.col("place") - 1 + F.col("before"))
    stride = 1 << 44
    runs = made.length * stride + made.low

    def seat(length: pa.Array, rank: pa.Array) -> pa.Array:
        l, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(runs, l * stride + r, side="right") - 1
        k = r - made.low[at]
        return pa.StructArray.from_arrays([pa.array(made.sequence[at] + k // made.each[at]), pa.array(made.offset[at] + k % made.each[at] * l)], ["sequence_id", "offset"])

    seated = ranked.withColumn("seat", F.arrow_udf(seat, "struct<sequence_id: long, offset: long>")("rest", "rank"))
    rest = seated.select(
        F.col("id").alias("doc_id"), (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"),
        F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "seat.sequence_id", "seat.offset")

    # whole windows: numbered after the others, by bucket and document
    whole = docs.where(F.size("full") > 0)
    counts = whole.groupBy("bucket").agg(F.sum(F.size("full")).alias("n")).collect()  # at most BUCKETS rows
    total, firsts = made.sequences, []
    for bucket, n in sorted((r["bucket"], r["n"]) for r in counts):
        firsts.append((bucket, total))
        total += n
    start = F.create_map(*[F.lit(x) for pair in firsts for x in pair])[F.col("bucket")] if firsts else F.lit(0)
    running = F.sum(F.size("full")).over(Window.partitionBy("bucket").orderBy("id", "rest_crc").rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.withColumn("first", start + F.coalesce(running, F.lit(0)))
    whole = whole.select("id", "doc_tokens", "first", F.posexplode("full").alias("k", "crc"))
    whole = whole.select(
        F.col("id").alias("doc_id"), (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.unionByName(whole)
