"""Token files and packing: exact ids, exact round trip, gapless sequences."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpora import SF_SMALL, edges, empty, prose
from roverlake.llm import packing, token_files, tokens
from roverlake.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
END = 2


@pytest.fixture(scope="module")
def encode():
    own = Tokenizer.from_file(PATH)
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, END]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_ids_equal_whole_texts(name):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    texts = ["", None, "it's don't I'LL we've", "a.b,c!d 'S 's 'sx .'s x'", "é.É é ≮ ≠x", "a b c\x1cd\x85e", "12a3 4.5,6",
             "<|endoftext|> a<|ENDOFTEXT|>b <| x", "Σίσυφος ΣΑΣ.ΣΑΣ İstanbul ǅ", "数据 处理。テスト", "😀😃!👍🏽", "x" * 5000, "\t\r\n  \n", "A_b-C/d\\e|f~g`h^i", "ﬁ ﬀ ½ ²", prose(9, 500)]
    ids, counts = tokens.Encoder(path).encode(pa.array(texts))
    edge = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(texts):
        assert ids[edge[i]:edge[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP_CHUNKS", 50)
    own, whole = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    for seed in range(6):
        text = prose(seed, 40)
        assert own.encode(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_encoder_takes_texts_of_more_chunks_than_it_keeps(monkeypatch):
    """One text alone goes over the limit, after others that share chunks with it."""
    monkeypatch.setattr(tokens, "KEEP_CHUNKS", 50)
    own, whole = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    small, large = prose(1, 30), prose(2, 400) + "\n" + prose(1, 30)
    assert len(set(small.split())) < 50 < len(set(prose(2, 400).split()) - set(small.split()))
    for text in (small, large, small, large, prose(3, 200), small):
        assert own.encode(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, encode):
    docs = table(spark, SF_SMALL, "documents")
    got = {r.doc_id: r for r in token_files.round_trip(spark, docs, PATH, END).collect()}
    start = 0
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = encode(r.text)
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not got


def test_token_files_edges(spark, encode):
    rows = sorted(((r.doc_id, r.text) for r in edges(spark).select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_files.round_trip(spark, edges(spark), PATH, END).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or 0, len(encode(t)), crc(encode(t))) for i, t in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert token_files.round_trip(spark, empty(spark), PATH, END).count() == 0


@pytest.mark.parametrize("total", [0, 1, 2048, 2048 * 64, 2048 * 64 + 1, 300_000])
def test_sequences_without_a_copy(tmp_path, total):
    ids = (np.arange(total) * 7 % 49000).astype(np.uint16)
    writer = token_files.Writer(f"file://{tmp_path}/x/y.arrows", np.uint16)
    for lo in range(0, total, 999):
        writer.add(ids[lo:lo + 999])
    writer.close()
    if not total:
        return
    reader = token_files.Reader(f"file://{tmp_path}/x/y.arrows")
    for k in {0, (total - 1) // 2048, total // 4096}:
        got, mask = reader.sequence(k)
        own = ids[k * 2048:(k + 1) * 2048]
        assert got[:len(own)].tolist() == own.tolist() and not got[len(own):].any() and len(got) == 2048
        assert mask.to_pylist() == [True] * len(own) + [False] * (2048 - len(own))
        assert not got.flags.owndata
    with pa.OSFile(f"{tmp_path}/x/y.arrows") as f:  # any Arrow stream reader gets the same
        assert pa.ipc.open_stream(f).read_all()["ids"].combine_chunks().flatten().to_numpy()[:total].tolist() == ids.tolist()


def check_packing(docs, pieces, encode, window=4096):
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    count = defaultdict(list)
    for i, text in docs:
        count[i].append(encode(text))
    for i, copies in count.items():
        want = sorted((len(ids), lo, len(ids[lo:lo + window]), crc(ids[lo:lo + window])) for ids in copies for lo in range(0, len(ids), window))
        assert sorted((p.doc_tokens, p.start, p.length, p.ids_crc32) for p in by_doc[i]) == want
    assert set(by_doc) == set(count)
    return len(sequences), sum(p.length for p in pieces)


def test_packing_places_every_id_once(spark, encode):
    docs = table(spark, SF_SMALL, "documents")
    n, total = check_packing([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], packing.pack(docs, PATH).collect(), encode)
    assert n <= -(-total // 4096) * 1.03 + 1


def test_packing_edges(spark, encode):
    docs = [(r.doc_id, r.text) for r in edges(spark).select("doc_id", "text").collect()]
    check_packing(docs, packing.pack(edges(spark), PATH).collect(), encode)
    assert packing.pack(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_seats_every_length(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(4096, np.int64)
    lengths = rng.integers(1, [4096, 300, 4000, 20, 4096][seed], 3000)
    np.add.at(hist, lengths, rng.integers(1, 50, 3000))
    made = packing.plan(hist, 4096)
    used = np.zeros(made.sequences, np.int64)
    for length in np.flatnonzero(hist):
        rank = np.arange(hist[length])
        at = np.searchsorted(made.length * (1 << 44) + made.low, length * (1 << 44) + rank, side="right") - 1
        assert (made.length[at] == length).all()
        np.add.at(used, made.sequence[at] + (rank - made.low[at]) // made.each[at], length)
    assert used.max() <= 4096 and used.min() > 0
    assert 1 - used.sum() / (4096 * made.sequences) < 0.025


def test_least_squares_is_near_the_optimum():
    """Complementary pairs have an exact solution."""
    hist = np.zeros(4096, np.int64)
    hist[[1000, 3096, 1500, 2596]] = 40, 40, 70, 70
    lengths, times = packing.combinations(hist, 4096)
    x = packing.least_squares(lengths, times, hist, 2000)
    used = np.bincount(lengths.ravel(), (times * x[:, None]).ravel(), 4096)
    assert np.abs(used - hist).max() < 2
    assert packing.plan(hist, 4096).sequences == 110
