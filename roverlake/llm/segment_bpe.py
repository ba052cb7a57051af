"""Byte-pair encoding with a segment tree over pair ranks, and decoding (operator 12).

A word's symbols form a linked list. A segment tree has one leaf for each adjacent
pair, holding the pair's merge rank and its place (nothing, if the pair has no
merge); a node holds the smaller of its two children, so the root is the leftmost
of the lowest-ranked pairs. A merge changes three leaves, whose ancestors are
updated in logarithmic time, until the root holds nothing. Words of a few dozen
symbols are merged side by side, one tree to a row of an array; longer ones alone.

Normalising and splitting into words is the library's; each distinct word of a
call is merged once, and chunks between white space are remembered by the worker
(``tokens.Encoder``). Decoding gathers the bytes of each id's token.

Defined results: a null text is an empty one, without ids; a special token's string
in a text is its id, as in the library; very long words and texts are taken whole;
repeated rows are rows of their own; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roverlake.llm.text import pieces
from roverlake.llm.tokens import Encoder

#: place bits of a leaf; the rank stands above them
PLACE = 32
NOTHING = np.int64(1) << np.int64(62)
#: pairs of the longest word that is merged side by side with others
SIDE_BY_SIDE = 64
#: leaves held at once
LEAVES = 1 << 20


class Merges:
    """The merge table of a vocabulary: ranks by pair, and the symbol each merge makes."""

    def __init__(self, model: dict) -> None:
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix")):
            raise ValueError("a plain BPE model is asked for")
        vocab = model["vocab"]
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        self.width = len(vocab) + 1
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.by_pair = {int(k): (r, int(m)) for r, (k, m) in reversed(list(enumerate(zip(key, self.made, strict=True))))}
        suffix = model.get("end_of_word_suffix") or ""
        letters = [c for c in vocab if len(c) == 1]
        self.inner = np.full(max(map(ord, letters)) + 1, -1, np.int64)
        self.last = self.inner.copy()
        for c in letters:
            self.inner[ord(c)] = vocab[c]
            self.last[ord(c)] = vocab.get(c + suffix, -1)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words, number of each)."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = self.inner[points]
        ends = np.cumsum(size)[size > 0] - 1
        out[ends] = self.last[points[ends]]
        if (out < 0).any():
            raise ValueError("a character has no symbol in the vocabulary")
        return out, size

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values of pairs; a negative symbol stands for the end of a word."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (left >= 0) & (right >= 0) & (self.keys[at] == key)
        return np.where(hit, (self.ranks[at] << PLACE) | place, NOTHING)


def merge_alone(symbols: list[int], merges: Merges) -> list[int]:
    """The merged symbols of one word of any length."""
    n = len(symbols)
    sym, after, before = [*symbols, -1], list(range(1, n + 2)), list(range(-1, n))
    width = 1 << max(n - 2, 0).bit_length()
    nothing, get, w = int(NOTHING), merges.by_pair.get, merges.width

    def leaf(i: int) -> int:
        found = get(sym[i] * w + sym[after[i]]) if sym[after[i]] >= 0 else None
        return nothing if found is None else found[0] << PLACE | i

    tree = [nothing] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = leaf(i)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while n > 1 and (root := tree[1]) != nothing:
        i = root & ((1 << PLACE) - 1)
        j = after[i]
        sym[i], sym[j] = int(merges.made[root >> PLACE]), -2
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        changed = [(i, leaf(i))]
        if j < n - 1:
            changed.append((j, nothing))
        if before[i] >= 0:
            changed.append((before[i], leaf(before[i])))
        for at, value in changed:
            at += width
            tree[at] = value
            at >>= 1
            while at:
                value = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == value:
                    break
                tree[at] = value
                at >>= 1
    return [s for s in sym[:n] if s >= 0]


def merge_rows(sym: np.ndarray, merges: Merges) -> np.ndarray:
    """Merges each row of ``sym`` (words, width + 2), padded with -1 and changed in place:
    what a merge uses up becomes -2. ``width``, the number of leaves, is a power of two."""
    m, width = len(sym), sym.shape[1] - 2
    depth = width.bit_length() - 1
    after = np.broadcast_to(np.arange(1, width + 3), sym.shape).copy()
    before = np.broadcast_to(np.arange(-1, width + 1), sym.shape).copy()
    tree = np.full((m, 2 * width), NOTHING)
    tree[:, width:] = merges.leaves(sym[:, :width], sym[:, 1:width + 1], np.arange(width))
    for d in range(depth - 1, -1, -1):
        tree[:, 1 << d:2 << d] = np.minimum(tree[:, 2 << d:4 << d:2], tree[:, (2 << d) + 1:4 << d:2])
    rows = np.flatnonzero(tree[:, 1] != NOTHING)
    while len(rows):
        root = tree[rows, 1]
        i = root & ((1 << PLACE) - 1)
        j = after[rows, i]
        k = after[rows, j]
        new = merges.made[root >> PLACE]
        sym[rows, i], sym[rows, j] = new, -2
        after[rows, i] = k
        before[rows, k] = i
        p = before[rows, i]
        tree[rows, width + i] = merges.leaves(new, sym[rows, k], i)
        inner = j < width
        tree[rows[inner], width + j[inner]] = NOTHING
        first = p >= 0
        tree[rows[first], width + p[first]] = merges.leaves(sym[rows[first], p[first]], new[first], p[first])
        for at in (np.where(inner, j, i), i, np.where(first, p, i)):
            at = (width + at) >> 1
            for _ in range(depth):
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                at >>= 1
        rows = rows[tree[rows, 1] != NOTHING]
    return sym


def merge_words(words: list[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each)."""
    sym, size = merges.symbols(words)
    first = np.cumsum(size) - size
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    for n in np.flatnonzero(size > SIDE_BY_SIDE + 1).tolist():
        found[n] = np.array(merge_alone(sym[first[n]:first[n] + size[n]].tolist(), merges), np.int64)
    width, below = 1, 0
    while width <= SIDE_BY_SIDE:
        group = np.flatnonzero((size > below) & (size <= width + 1))
        for lo in range(0, len(group), max(1, LEAVES // width)):
            some = group[lo:lo + max(1, LEAVES // width)]
            column = np.arange(width + 2)
            inside = column < size[some, None]
            rows = np.where(inside, sym[np.minimum(first[some, None] + column, len(sym) - 1)], -1)
            rows = merge_rows(rows, merges)
            left = rows >= 0
            for n, ids in zip(some.tolist(), np.split(rows[left], np.cumsum(left.sum(axis=1))[:-1]), strict=True):
                found[n] = ids
        below, width = width + 1, width * 2
    return (np.concatenate(found) if found else np.empty(0, np.int64)), np.fromiter(map(len, found), np.int64, len(found))


class TreeEncoder(Encoder):
    """The chunk table with words merged by segment trees instead of the library's model."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        added = spec.get("added_tokens", [])
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that are matched as they stand are asked for")
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")" if added else "(?!)()")
        self.spaced, self.token, self.token_at = _token_bytes(spec)

    def _words(self, text: str) -> list[str]:
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        parts = [[p if p in self.special else self._words(p) for p in (self.cut.split(t) if "<|" in t else [t]) if p] for t in texts]
        number: dict[str, int] = {}
        for text in parts:
            for part in text:
                if not isinstance(part, str):
                    for w in part:
                        number.setdefault(w, len(number))
        ids, size = merge_words(list(number), self.merges)
        of_word = np.split(ids, np.cumsum(size)[:-1]) if len(size) else []
        out = []
        for text in parts:
            rows = [x for part in text for x in ([np.array([self.special[part]])] if isinstance(part, str) else [of_word[number[w]] for w in part])]
            out.append(np.concatenate(rows) if rows else np.empty(0, np.int64))
        return out

    def decoded(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text."""
        size = self.token_at[ids + 1] - self.token_at[ids]
        before = np.cumsum(size) - size
        data = self.token[np.arange(int(size.sum())) + np.repeat(self.token_at[ids] - before, size)].tobytes()
        return data[:-1] if self.spaced else data.decode("utf-8", "replace").encode()


def _token_bytes(spec: dict) -> tuple[bool, np.ndarray, np.ndarray]:
    """Bytes of each id's token, with offsets; without a decoder tokens are set apart by blanks."""
    decoder = spec.get("decoder")
    if decoder is not None and decoder["type"] != "ByteLevel":
        raise ValueError("no decoder, or one for byte-level tokens, is asked for")
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    if decoder is None:
        made = [(tokens[i] + " ").encode() if i in tokens else b"" for i in range(max(tokens) + 1)]
    else:
        # fixed values: the byte-level alphabet shows printable Latin-1 bytes as themselves, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        made = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (tokens.get(i, "") for i in range(max(tokens) + 1))]
    return decoder is None, np.frombuffer(b"".join(made), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in made])])


@lru_cache(maxsize=1)
def tree_encoder(path: str) -> TreeEncoder:
    """One encoder for each Python worker."""
    return TreeEncoder(path)


def round_trip(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""

    def run(batches):
        own = tree_encoder(path)
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                ids, counts = own.encode(batch.column(1).slice(a, b - a))
                edge = np.concatenate([[0], np.cumsum(counts)]).tolist()
                ids = ids.astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = list(zip(edge[:-1], edge[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts),
                     pa.array([hashlib.sha256(raw[4 * lo:4 * hi]).hexdigest() for lo, hi in spans], pa.string()),
                     pa.array([hashlib.sha256(own.decoded(ids[lo:hi])).hexdigest() for lo, hi in spans], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
