"""Substring dedup by content-defined chunking (operator 1).

A gear hash rolls over the bytes of a text; a word whose last byte gives a
small hash ends a chunk, unless the word before did so too. The hash knows the
last 16 bytes only, so an insertion moves the cuts near it and no others, and a
passage has the same chunks wherever it stands. Chunks are compared by a 64-bit
digest: one that also occurs earlier, by document id and place, is a later copy.
Runs of neighbouring later copies with ``min_words`` words or more are the
repeated passages; a run takes several equal digests in a row, so that chance
collisions do not make one.

A passage loses at most its cut chunks at both ends (about five words each), so
the default of 20 words finds passages of over 50 words, and lines that are
merely common stay.

Counting digests and joining them back are plain aggregates and joins: no group
of copies is ever gathered in one place.

Defined results: a null, empty or blank text has no chunk; rows of the same id
and text are one document; those of the same id and different texts are ordered
by a hash of the text; a null id comes first; copies within one document count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roverlake.llm.common import cut
from roverlake.llm.text import Words, buffers, mix, pieces, span_hashes

#: a chunk ends after one word in about four and a half, and after ``MOST`` words at the latest
LIMIT, MOST = 65536 // 3, 64
WINDOW = 16
MIN_WORDS = 20
#: bits of the hash that tells texts of one id apart; with each chunk it is dealt out
#: twice, and the upper half would be a seventh of what is moved
TEXT = np.uint64(0xFFFFFFFF)


def _gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j over the last 16 bytes, by four doublings."""
    h = (mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(20)) >> np.uint64(48)).astype(np.uint16)[data]
    for k in (1, 2, 4, 8):
        more = h.copy()
        more[k:] += h[:-k] << np.uint16(k)
        h = more
    return h


def _spaced() -> np.ndarray:
    ok = np.ones(256, bool)
    ok[list(b" \t\r\n")] = False
    return ok


def chunk(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each chunk, one past its last word, its digest)."""
    words = Words(texts, keep=_spaced(), lower=False)
    n = len(words.starts)
    if not n:
        none = np.empty(0, np.int64)
        return words, none, none, np.empty(0, np.uint64)
    end = words.ends - 1
    small = (_gear(words.data)[end] < LIMIT) & (end - words.offsets[words.doc] >= WINDOW - 1)
    cuts = small.copy()
    cuts[1:] &= ~(small[:-1] & (words.doc[1:] == words.doc[:-1]))
    cuts[words.first[1:][np.diff(words.first) > 0] - 1] = True
    stop = np.flatnonzero(cuts) + 1
    start = np.concatenate([[0], stop[:-1]])
    parts = -(-(stop - start) // MOST)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, last = np.repeat(start, parts) + nth * MOST, np.repeat(stop, parts)
        start, stop = first, np.minimum(first + MOST, last)
    return words, start, stop, span_hashes(words.data, words.starts[start], words.ends[stop - 1])


CHUNK = "d long, id long, t long, words long, chars long"


def _chunks(batches):
    """(digest, id, t, first word and words, first and last character) of each chunk; pairs in one long."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in pieces(texts):
            words, start, stop, digest = chunk(texts.slice(a, b - a))
            doc = words.doc[start]
            whole = span_hashes(words.data, words.offsets[:-1], words.offsets[1:]) & TEXT
            count = np.cumsum((words.data & 0xC0) != 0x80) if len(words.data) else np.empty(0, np.int64)
            base = np.concatenate([[0], count])[words.offsets[:-1]]
            lo = count[words.starts[start]] - 1 - base[doc]
            hi = count[words.ends[stop - 1] - 1] - base[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest.view(np.int64)), ids.slice(a, b - a).take(pa.array(doc)), pa.array(whole.view(np.int64)[doc]), pa.array((start - words.first[doc]) << 32 | (stop - start)), pa.array(lo << 32 | hi)],
                names=["d", "id", "t", "words", "chars"],
            )


def repeated_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, t, start, length, n_words, source_id, source_start): later copies of
    passages, in characters of the text, with the first chunk's earliest place."""
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    chunks = rows.mapInArrow(_chunks, CHUNK)
    repeated = chunks.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d")
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF))
    found = chunks.join(repeated, "d", "left_semi").distinct()
    found = cut(found.select("d", "id", "t", high("words").alias("w"), low("words").alias("n"), high("chars").alias("lo"), low("chars").alias("hi")))
    place = F.struct("id", "t", "w")
    first = found.groupBy("d").agg(F.min(F.struct("id", "t", "w", "lo")).alias("source"))
    later = found.join(first, "d").where(place > F.struct("source.id", "source.t", "source.w"))
    order = Window.partitionBy("id", "t").orderBy("w")
    # neighbours in the text, and in the earliest occurrence too
    beside = F.coalesce(F.lag(F.col("w") + F.col("n")).over(order) == F.col("w"), F.lit(False))
    goes_on = F.col("source.id").eqNullSafe(F.lag("source.id").over(order)) & (F.col("source.t") == F.lag("source.t").over(order)) & (F.col("source.w") == F.lag(F.col("source.w") + F.col("n")).over(order))
    later = later.withColumn("beside", beside).withColumn("linked", F.col("beside") & F.coalesce(goes_on, F.lit(False)))
    after = {c: F.coalesce(F.lead(c).over(order), F.lit(False)) for c in ("beside", "linked")}
    # a chunk at the end of a run that stands elsewhere in the earliest occurrence is there by chance
    inside = F.col("linked") | after["linked"] | (F.col("beside") & after["beside"]) | (F.col("n") >= min_words)
    runs = later.withColumn("inside", inside).where("inside")
    new = F.coalesce(F.lag(F.col("w") + F.col("n")).over(order) != F.col("w"), F.lit(True))
    runs = runs.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy("id", "t", "run").agg(
        F.min("lo").alias("start"), (F.max("hi") - F.min("lo")).alias("length"), F.sum("n").alias("n_words"),
        F.min_by("source", "w").alias("source"))
    return spans.where(F.col("n_words") >= min_words).select("id", "t", "start", "length", "n_words", F.col("source.id").alias("source_id"), F.col("source.lo").alias("source_start"))


def _hashed(texts: pa.Array) -> pa.Array:
    data, off = buffers(texts)
    return pa.array((span_hashes(data, off[:-1], off[1:]) & TEXT).view(np.int64))


def _without(texts: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
    out = []
    for text, begin, size in zip(texts.to_pylist(), starts.to_pylist(), lengths.to_pylist(), strict=True):
        if text is not None and begin:
            kept, at = [], 0
            for lo, n in sorted(zip(begin, size, strict=True)):
                kept.append(text[at:lo])
                at = lo + n
            text = "".join([*kept, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def dedup_substrings(documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later copies of passages cut out of ``text``."""
    spans = repeated_spans(documents, key, text, min_words).groupBy("id", "t").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    own = F.col(text).cast("string")
    docs = documents.select(F.struct(*documents.columns).alias("row"), F.col(key).cast("long").alias("own_id"), own.alias("own"), F.arrow_udf(_hashed, "long")(own).alias("own_t"))
    docs = docs.join(spans, docs["own_id"].eqNullSafe(spans["id"]) & (docs["own_t"] == spans["t"]), "left")
    cleaned = F.arrow_udf(_without, "string")("own", F.col("spans.start"), F.col("spans.length"))
    out = F.when(F.col("spans").isNull(), F.col("own")).otherwise(cleaned)
    return docs.select(*((out if c == text else F.col("row")[c]).alias(c) for c in documents.columns))
