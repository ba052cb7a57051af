"""Conversation repair, segment-tree BPE and the Merkle manifest against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpora import CLASHES, SF_SMALL, edges, empty, prose
from roverlake.llm import conversation_repair as repair
from roverlake.llm import merkle, segment_bpe
from roverlake.llm.common import fold, table

BLANK = "\x20\t\n\x0b\x0c\r"


def spaced(v):
    return " " if v is None else str(v)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()))


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = text.strip(BLANK)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def step(role):
    """Role that may be put where the last emitted initial is ``role`` ('' at first)."""
    return "assistant" if role == "u" else "user"


def edits(rows, faults, most):
    """All (cost, audit, emitted rows) of edits with at most ``most`` inserts in a row."""
    def go(i, last, cost, audit, out, run):
        if run < most:
            new = step(last)
            yield from go(i, new[0], cost + 3, audit + "I", [*out, (new, "")], run + 1)
        if i == len(rows):
            if last in ("", "a"):
                yield cost, audit, out
            return
        role, text = rows[i][2:]
        yield from go(i + 1, last, cost + 4, audit + "D", out, 0)
        if faults[i] in ("blank", "duplicate"):
            return
        late = 3 * (faults[i] == "truncated")
        new = step(last)
        yield from go(i + 1, new[0], cost + 3 + late, audit + "R", [*out, (new, text)], 0)
        if (role[:1] == "s" and not last) or role[:1] == new[0]:
            yield from go(i + 1, role[0], cost + late, audit + "K", [*out, (role, text)], 0)

    return go(0, "", 0, "", [], 0)


def cheapest(rows, faults):
    """The same by keeping the cheapest edits for each last initial."""
    best = {"": (0, "", [])}
    for i in range(len(rows) + 1):
        for last, (cost, audit, out) in list(best.items()):
            for _ in range(2):
                new = step(last)
                cost, audit, out, last = cost + 3, audit + "I", [*out, (new, "")], new[0]
                best[last] = min(best.get(last, (cost, audit, out)), (cost, audit, out), key=lambda b: b[:2])
        if i == len(rows):
            break
        after = {}
        for last, b in best.items():
            one = (((b[0] + c, b[1] + a, b[2] + o), (o[-1][0][0] if o else last)) for c, a, o in edits_of(rows[i], faults[i], last))
            for found, to in one:
                after[to] = min(after.get(to, found), found, key=lambda x: x[:2])
        best = after
    return min((b for last, b in best.items() if last in ("", "a")), key=lambda b: b[:2])


def edits_of(row, fault, last):
    yield 4, "D", []
    if fault not in ("blank", "duplicate"):
        late, new = 3 * (fault == "truncated"), step(last)
        yield 3 + late, "R", [(new, row[3])]
        if (row[2][:1] == "s" and not last) or row[2][:1] == new[0]:
            yield late, "K", [(row[2], row[3])]


def brute_repairs(original, rows, solve=cheapest):
    out = []
    for conv in {r[0] for r in original}:
        own = in_order(r for r in rows if r[0] == conv)
        faults = faults_of(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, emitted = solve(own, faults)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in emitted).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = "conv_id long, turn long, role string, text string"


def repairs(spark, rows, schema=ROWS):
    found = repair.repaired(spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in CLASHES + ["conv", "chunk", "at", "audit", "cost"]}))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def random_rows(seed, conversations, sizes):
    rng = random.Random(seed)
    return [
        (c or None, rng.choice([t, t, t, None, t + 1, 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]),
         rng.choice(["a.", "b!", "c", "d? ", "", "  ", None, "x.\n", "\x1c", f"text {t}.", "é"]))
        for c in range(conversations) for t in range(rng.choice(sizes))]


def test_repairs_equal_all_edits(spark):
    rows = random_rows(1, 150, [1, 2, 3, 4])

    def all_edits(own, faults):
        return min(edits(own, faults, 2), key=lambda e: e[:2])

    assert repairs(spark, rows) == brute_repairs(rows, damage(rows), all_edits) == brute_repairs(rows, damage(rows))


@pytest.mark.parametrize("chunk", [0, 2, 10])
def test_repairs_of_conversations_of_any_length(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rng = random.Random(7)
    rows = random_rows(2, 40, [1, 5, 12]) + [(10 ** 12, i, rng.choice(["user", "assistant", "system"]), f"t{i % 900}" + rng.choice([".", ".", ""])) for i in range(3000)]
    assert repairs(spark, rows) == brute_repairs(rows, damage(rows))


def test_repairs_take_edge_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, None, "user", "x" * 300_000 + "."), (1, None, "user", "x" * 300_000 + "."), (2, 1, "", ""),
            (3, 5, "system", "s."), (4, 2 ** 40, "assistant", "a."), (4, 1, "user", "u."), (5, 1, "user", "q?"), (5, 1, "user", "q?"), (5, 1, "assistant", "a!")]
    dropped = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((dropped, 1, "user", "gone."))
    found = repairs(spark, rows)
    assert found == brute_repairs(rows, damage(rows))
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found
    assert repairs(spark, []) == []


def test_rules_are_products_of_their_parts(spark):
    """Every rule's matrix spells out the edits of the symbols that it stands for."""
    pieces = spark.createDataFrame([("EIEIEI",), ("AEIEIFJ",), ("EIEI",), ("EEEE",)], "seq string")
    grammar = repair.learn(pieces)
    assert len(grammar.rules) >= 2 and all(len(pair) == 2 for pair, _ in grammar.rules)
    plain = repair.Grammar([])
    for piece in ("EIEIEI", "AEIEIFJ", "EEEEPNCA", "MMMM"):
        assert len(grammar.compressed(piece)) <= len(piece) and grammar.entries(piece) == plain.entries(piece)
    assert len(grammar.compressed("EIEIEI")) < 4


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_trees_merge_as_the_library_does(name):
    path = public_tokenizers.path(name)
    whole, own = Tokenizer.from_file(path), segment_bpe.TreeEncoder(path)
    rng = random.Random(3)
    texts = ["", None, "it's don't I'LL we've", "a.b,c!d 'S 'sx .'s x'", "é.É é ≮ ≠x", "a b c\x1cd\x85e", "12a3 4.5,6", "<|endoftext|> a<|ENDOFTEXT|>b <| x",
             "<|startoftext|>foo<|endoftext|><|endoftext|>", "Σίσυφος ΣΑΣ.ΣΑΣ İstanbul ǅ", "数据 处理。テスト", "😀😃!👍🏽", "x" * 5000, "\t\r\n  \n", "ﬁ ﬀ ½ ²", prose(9, 500),
             "ab" * 40 + " " + "the" * 30, *("".join(rng.choice("abcdetionst ") for _ in range(rng.randint(1, 300))) for _ in range(200))]
    ids, counts = own.encode(pa.array(texts))
    edge = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(texts):
        got, want = ids[edge[i]:edge[i + 1]].astype(np.int64), whole.encode(text or "", add_special_tokens=False).ids
        assert got.tolist() == want and own.decoded(got).decode() == whole.decode(want, skip_special_tokens=False), text


def test_words_side_by_side_equal_words_alone(monkeypatch):
    own = segment_bpe.TreeEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    words = ["".join(rng.choice("thenaistor") for _ in range(n)) for n in range(2, 66) for _ in range(5)]  # with no width left, one symbol has no place
    ids, size = segment_bpe.merge_words(words, own.merges)
    monkeypatch.setattr(segment_bpe, "SIDE_BY_SIDE", 0)
    alone, sizes = segment_bpe.merge_words(words, own.merges)
    assert ids.tolist() == alone.tolist() and size.tolist() == sizes.tolist()


def test_round_trip_digests(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for docs in (table(spark, SF_SMALL, "documents"), edges(spark), empty(spark)):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = whole.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = segment_bpe.round_trip(docs, path)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        leaf = digest(*map(field, r))
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, digest(*map(field, (*r[:3], r[3] + 1, r[4]))) if hit else leaf, r[0]))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            yield (level[i ^ 1] if i ^ 1 < len(level) else ""), i & 1
            i //= 2

    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = [sorted(trees[x], key=lambda r: r[:3]) for x in langs]
    built = [levels([r[2] for r in rows]) for rows in own]
    top = levels([t[-1][0] for t in built])
    for k, (rows, tree) in enumerate(zip(own, built, strict=True)):
        for i, r in enumerate(rows):
            steps = [*path(tree, i), *path(top, k)]
            folded = r[3]
            for s, left in steps:
                folded = digest(s, folded) if left else digest(folded, s)
            yield r[4], r[2], tree[-1][0], top[-1][0], digest(*(s for s, _ in steps)), folded, folded == top[-1][0]


def manifest(docs):
    found = merkle.manifest_of(docs, fold("doc_id", 7) == 0)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=str)


def of(docs):
    return sorted(brute_manifest([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]), key=str)


@pytest.mark.parametrize(("hop", "broadcast"), [(10, True), (1, True), (3, False)])
def test_manifest_equals_brute_force(spark, monkeypatch, hop, broadcast):
    monkeypatch.setattr(merkle, "HOP", hop)
    if not broadcast:
        monkeypatch.setattr(merkle, "climb", lambda spark, m, own=merkle.climb: own(spark, m, 0))
    docs = table(spark, SF_SMALL, "documents")
    assert manifest(docs) == of(docs)


def test_manifest_takes_edge_rows(spark):
    docs = edges(spark).withColumn("n_chars", F.when(F.col("doc_id") > 5, F.length("text"))).withColumn("lang", F.when(F.col("doc_id") < 9, F.lit("é")).when(F.col("doc_id") < 11, "z"))
    docs = docs.withColumns({c: F.lit(1) for c in ("tree", "pos", "digest", "found", "root", "folded", "leaf", "stage")})
    assert manifest(docs) == of(docs)
    one = docs.where("doc_id = 10")
    assert manifest(one) == of(one) and manifest(one)[0][1] == manifest(one)[0][3]
    assert manifest(docs.where("false")) == []


def test_manifest_finds_what_was_changed(spark):
    found = merkle.manifest_of(table(spark, SF_SMALL, "documents"), F.col("doc_id") == 17)
    assert [r.doc_id for r in found.where("not verified").collect()] == [17]
