"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

For a vocabulary whose pre-tokeniser never joins characters across white space
(nor an ASCII letter with ASCII punctuation other than the apostrophe), the ids
of a text are the ids of its chunks in order. Such texts are cut into chunks,
the distinct chunks of a batch are looked up in a table kept by the Python
worker, and only unseen ones go to the library. Any other vocabulary, and any
text that may hold a special token's string, is encoded whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from roverlake.llm.text import buffers, pieces, span_hashes

#: chunks a worker remembers; beyond it the table starts anew (a piece of more is held while it is encoded)
KEEP_CHUNKS = 1_500_000
#: chunks in one call of the library, whose results take far more room than the ids
CALL_CHUNKS = 100_000
SPACE, LETTER, MARK, OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and ASCII lower case."""
    kind = np.full(256, OTHER, np.uint8)
    kind[list(b" \t\n\r")] = SPACE
    kind[list(range(ord("a"), ord("z") + 1))] = LETTER
    kind[list(range(ord("A"), ord("Z") + 1))] = LETTER
    kind[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = MARK
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return kind, lower


def _chunkable(spec: dict) -> bool:
    """True for lower-casing BPE over pieces matched by a pattern that holds letters,
    digits and other marks apart, with no effect across white space."""
    normal = json.dumps(spec.get("normalizer"))
    split = json.dumps(spec.get("pre_tokenizer"))
    return (
        spec["model"].get("type", "BPE") == "BPE" and not spec["model"].get("dropout")
        and '"Lowercase"' in normal and "Prepend" not in normal and "Strip" not in normal
        and "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in split and '"Removed"' in split and '"add_prefix_space": true' not in split
        and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    )


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.chunkable = _chunkable(json.load(f))
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 16, self.kind), 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        got = [x for lo in range(0, len(chunks), CALL_CHUNKS) for x in self.whole(chunks[lo:lo + CALL_CHUNKS])]
        size = np.fromiter(map(len, got), np.int64, len(got))
        need = self.used + int(size.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.empty(need, self.kind)])
        self.ids[self.used:need] = np.fromiter((i for x in got for i in x), self.kind, need - self.used)
        at = self.used + np.cumsum(size) - size
        self.used = need
        into = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, into, keys), np.insert(self.at, into, at), np.insert(self.size, into, size)

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == keys[ok]
        return at, ok

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) for one piece of a batch."""
        data, off = buffers(texts)
        n = len(off) - 1
        special = np.zeros(n, bool)
        if self.chunkable:
            hit = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
            special[np.searchsorted(off, hit, side="right") - 1] = True
        else:
            special[:] = True
        kinds, lower = _classes()
        kind = kinds[data]
        data = lower[data]
        before = np.empty(len(kind), np.uint8)
        before[1:] = kind[:-1]
        before[off[:-1][off[:-1] < len(data)]] = SPACE
        turn = (before == SPACE) | ((kind == MARK) & (before == LETTER)) | ((kind == LETTER) & (before == MARK))
        starts = np.flatnonzero((kind != SPACE) & turn)
        # a chunk ends at the next white space, chunk or text
        stops = np.flatnonzero((kind == SPACE) | turn)
        stops = np.append(stops, len(data))
        ends = stops[np.searchsorted(stops, starts, side="right")]
        doc = np.searchsorted(off, starts, side="right") - 1
        if special.any():
            keep = ~special[doc]
            starts, ends, doc = starts[keep], ends[keep], doc[keep]
        keys, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at, ok = self._known(keys)
        if not ok.all():
            new = np.flatnonzero(~ok)
            raw = data.tobytes()
            if len(self.keys) + len(new) > KEEP_CHUNKS:  # the table starts anew with all chunks of this piece, however many
                self._forget()
                new = np.arange(len(keys))
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at, ok = self._known(keys)
            assert ok.all()
        size, at = self.size[at][back], self.at[at][back]
        counts = np.bincount(doc, size, n).astype(np.int64)
        begin = np.cumsum(size) - size
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(at - begin, size)] if len(size) else np.empty(0, self.kind)
        if len(self.keys) > KEEP_CHUNKS:
            self._forget()
        if special.any():
            ids, counts = self._with_whole(texts, np.flatnonzero(special), ids, counts)
        return ids, counts

    def _with_whole(self, texts: pa.Array, which: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = dict(zip(which.tolist(), self.whole([t or "" for t in texts.take(pa.array(which)).to_pylist()]), strict=True))
        edge = np.concatenate([[0], np.cumsum(counts)])
        rows = [np.array(whole[i], self.kind) if i in whole else ids[edge[i]:edge[i + 1]] for i in range(len(counts))]
        return np.concatenate(rows) if rows else ids, np.array([len(r) for r in rows], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)


def encoded(path: str, texts: pa.Array, end: int):
    """For each piece of a batch: (first, last+1, ids with the end id after each text, number of them)."""
    own = encoder(path)
    for a, b in pieces(texts):
        ids, counts = own.encode(texts.slice(a, b - a))
        closed = np.insert(ids, np.cumsum(counts), end)
        yield a, b, closed, counts + 1
