"""Cheapest structure repair of conversations by a grammar-compressed DP (operator 11).

A repaired conversation has the role initials ``(s?(ua)+)?``. A row is a symbol: its
role's initial and its first fault. Read by the automaton of that pattern, a symbol
is a 4 x 4 min-plus matrix over states: the cheapest edits from one state to
another, with inserts before the row. Rows in order are cut into pieces of at most
``2^CHUNK`` (a conversation of any size is many bounded groups). Re-Pair over the
pieces of all conversations makes rules of the most frequent neighbouring symbols,
counted by Spark; each rule's matrix is the product of its two, made once, bottom-up.
A piece is then the product of a few matrices. An entry keeps its cost, its rank
among the entries of its row, and its audit as a rope: the state in the middle, so
the halves are those of the two parts and are only spelled out for pieces.

Ranks decide ties without comparing texts: edits that read the same rows and end
with a row's edit are never a prefix of one another, so the order of two joined
audits is that of their first halves, or of the second if those are the same.

The pieces of a conversation are joined by a vector of four states, and its rows
streamed past the chosen edits into one SHA-256. That digest is sequential, so the
rows of one conversation pass through one task, in order and a batch at a time; what
is held is its edits, a letter a row, which are also a cell of the result.

Defined results: a null role or text is one space; a null id is a conversation of
its own; rows of the same turn are ordered by a digest of role and text, so equal
ones adjoin; a conversation without rows has an empty audit; roles count by their
first letter, case kept; texts are read whole; an empty table gives no row.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roverlake.llm.common import cut

#: rows of a piece, as a power of two
CHUNK = 10
#: rules of the grammar; pairs that occur less often than MIN_USES make none
RULES = 192
MIN_USES = 2
#: short pieces of which a worker remembers the entries
KNOWN = 10_000
#: pairs made to rules between two counts
AT_ONCE = 16
FIRST_RULE = 0xE000  # private-use characters stand for rules
#: symbols: four classes of role initials, each with four faults
SYMBOLS = "ABCDEFGHIJKLMNOP"
CLASSES, FAULTS = "sua", ("", "truncated", "blank", "duplicate")
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: states: nothing yet; after a system row; after a user row; after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
BLANKS = "\x20\t\n\x0b\x0c\r"


def turned(state: int) -> int:
    """State after a user or assistant row is put where one is wanted."""
    return ASSISTANT if state == USER else USER


def inserts(state: int) -> list[tuple[str, int]]:
    """The cheapest inserts to each state that can be reached by them."""
    found, text = [("", state)], ""
    while (state := turned(state)) not in (s for _, s in found):
        text += "I"
        found.append((text, state))
    return found


def kept(state: int, role: str) -> int | None:
    """State after a row that keeps its role; None where it may not stand."""
    if role == "s":
        return SYSTEM if state == START else None
    return turned(state) if role == ("a" if state == USER else "u") else None


class Matrix:
    """Entries (cost, rank, rope) by [from][to]; a rope is a text or a middle state.
    ``first`` and ``second`` are the matrices that a middle state refers to."""

    __slots__ = ("entries", "first", "second")

    def __init__(self, found: list[list], first: Matrix | None = None, second: Matrix | None = None) -> None:
        """found[i][j]: None or (cost, order, rope), order comparable within the row."""
        self.first, self.second = first, second
        self.entries = []
        for row in found:
            order = sorted(x[1] for x in row if x)
            self.entries.append([x and (x[0], order.index(x[1]), x[2]) for x in row])

    def __matmul__(self, other: Matrix) -> Matrix:
        a, b = self.entries, other.entries
        found = [[min(((a[i][k][0] + b[k][j][0], (a[i][k][1], b[k][j][1]), k) for k in STATES if a[i][k] and b[k][j]), default=None) for j in STATES] for i in STATES]
        return Matrix(found, self, other)

    def audit(self, i: int, j: int) -> str:
        out, todo = [], [(self, i, j)]
        while todo:
            m, i, j = todo.pop()
            rope = m.entries[i][j][2]
            if isinstance(rope, str):
                out.append(rope)
            else:
                todo += [(m.second, rope, j), (m.first, i, rope)]
        return "".join(out)


def symbol_matrix(symbol: str) -> Matrix:
    role, fault = divmod(SYMBOLS.index(symbol), len(FAULTS))
    role, fault = (CLASSES + "-")[role], FAULTS[fault]
    late = TRUNCATED if fault == "truncated" else 0
    found: list[list] = [[None] * 4 for _ in STATES]
    for i in STATES:
        for text, s in inserts(i):
            edits = [("D", s, DELETE)]
            if fault not in ("blank", "duplicate"):
                edits.append(("R", turned(s), REROLE + late))
                if (stays := kept(s, role)) is not None:
                    edits.append(("K", stays, late))
            for edit, j, cost in edits:
                new = (INSERT * len(text) + cost, text + edit, text + edit)
                found[i][j] = min(found[i][j] or new, new)
    return Matrix(found)


class Grammar:
    """Rules (pair, symbol) in the order they were made, and the matrix of each symbol."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules, self.known = rules, {}
        self.matrices = {c: symbol_matrix(c) for c in SYMBOLS}
        for pair, symbol in rules:
            self.matrices[symbol] = self.matrices[pair[0]] @ self.matrices[pair[1]]

    def __reduce__(self):
        return Grammar, (self.rules,)  # matrices are made again from the rules

    def compressed(self, piece: str) -> str:
        for pair, symbol in self.rules:
            piece = piece.replace(pair, symbol)
        return piece

    def matrix(self, piece: str) -> Matrix:
        first, *others = self.compressed(piece)
        out = self.matrices[first]
        for c in others:
            out = out @ self.matrices[c]
        return out

    def entries(self, piece: str) -> tuple[list, list, list]:
        """Costs, ranks and audits by 4 * from + to; short pieces are remembered."""
        if piece in self.known:
            return self.known[piece]
        m = self.matrix(piece)
        cells = [(m.entries[i][j], i, j) for i, j in product(STATES, STATES)]
        made = [x and x[0] for x, _, _ in cells], [x and x[1] for x, _, _ in cells], [x and m.audit(i, j) for x, i, j in cells]
        if len(piece) <= 32:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[piece] = made
        return made


def learn(pieces: DataFrame, rules: int = RULES, seq: str = "seq") -> Grammar:
    """Re-Pair over all pieces: pairs are counted where they stand, equal pieces once
    with their number, and the most frequent ones that share no symbol become
    rules together. What comes to the driver is bounded by the symbols' pairs."""
    distinct = cut(pieces.groupBy(seq).agg(F.count(F.lit(1)).alias("n")))
    made: list[tuple[str, str]] = []
    text = F.col(seq)
    while len(made) < rules:
        starts = F.sequence(F.lit(1), F.length("text") - 1)
        pairs = distinct.select(text.alias("text"), "n").where("length(text) > 1").select(F.explode(F.transform(starts, lambda i: F.substring("text", i, F.lit(2)))).alias("pair"), "n")
        counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_USES).orderBy(F.desc("n"), "pair").limit(rules).collect()
        used: set[str] = set()
        for row in counts:
            if len(made) < rules and not used & set(row["pair"]) and len(used) < 2 * AT_ONCE:
                used |= set(row["pair"])
                made.append((row["pair"], chr(FIRST_RULE + len(made))))
                text = F.replace(text, F.lit(made[-1][0]), F.lit(made[-1][1]))
        if not used:
            break
    return Grammar(made)


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text of the rows left after the damage that crc32 of
    ``conv:turn`` modulo 20 names: 0 drops a row, 1 empties its text, 2 takes out
    its marks ``.!?``, 3 repeats it, 4 makes it the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(fault == 4, "user").otherwise(spaced(role)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text)).alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in order with their place (``at`` grows with conversation and turn) and
    piece. Ranges split a conversation of any size; rows are compared by digest."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv", "turn", spaced("role").alias("role"), spaced("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keys = ["conv", "turn", "digest", "row"]
    rows = rows.withColumns({"digest": digest, "row": F.monotonically_increasing_id()})
    rows = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("row"))
    return rows.withColumn("chunk", F.shiftright("at", CHUNK))


def symbols(rows: DataFrame) -> DataFrame:
    """conv, chunk, at and symbol of ordered rows. A row is a duplicate unless it is
    the first of its conversation with its digest; firsts are found by their place."""
    firsts = rows.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    ending = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    light = rows.select("conv", "chunk", "at", role.alias("role"), ending.alias("ending")).join(firsts, "at", "left")
    fault = F.when(F.col("ending") == "", 2).when(F.col("first").isNull(), 3).when(~F.col("ending").isin(".", "!", "?"), 1).otherwise(0)
    return light.select("conv", "chunk", "at", F.substring(F.lit(SYMBOLS), F.col("role") * len(FAULTS) + fault + 1, F.lit(1)).alias("symbol"))


def pieces_of(marked: DataFrame) -> DataFrame:
    """conv, chunk and the symbols of each piece of at most 2^CHUNK rows."""
    own = F.array_sort(F.collect_list(F.struct("at", "symbol")))
    return marked.groupBy("conv", "chunk").agg(own.alias("own")).select("conv", "chunk", F.array_join(F.transform("own", lambda x: x["symbol"]), "").alias("seq"))


def evaluated(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """Adds the 16 entries of each piece's matrix (null: no such edits)."""

    def entries(seq: pa.Array) -> pa.Array:
        found = [grammar.entries(s) for s in seq.to_pylist()]
        kinds = {"cost": pa.int32(), "rank": pa.int32(), "audit": pa.string()}
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate(kinds.values())], list(kinds))

    matrix = F.arrow_udf(entries, "struct<cost: array<int>, rank: array<int>, audit: array<string>>")
    return pieces.withColumn("matrix", matrix("seq")).select("conv", "chunk", "seq", "matrix.*")


class _Joined:
    """A conversation's pieces so far: for each state cost, rank and the edits as a
    linked list (before, chunk, state before, audit); and the counts of its faults."""

    def __init__(self) -> None:
        self.vector: list = [(0, 0, None), None, None, None]
        self.counts, self.last = [0] * 4, ""

    def add(self, chunk: int, seq: str, cost: list, rank: list, audit: list) -> None:
        found = []
        for j in STATES:
            ways = [(v[0] + cost[4 * i + j], (v[1], rank[4 * i + j]), i) for i, v in enumerate(self.vector) if v and cost[4 * i + j] is not None]
            best = min(ways, default=None)
            found.append(best and (best[0], best[1], (self.vector[best[2]][2], chunk, best[2], audit[4 * best[2] + j])))
        order = sorted(f[1] for f in found if f)
        self.vector = [f and (f[0], order.index(f[1]), f[2]) for f in found]
        for k, c in enumerate(("CGKO", "DHLP", "BFJN")):
            self.counts[k] += sum(map(seq.count, c))
        roles = self.last + "".join((CLASSES + "-")[SYMBOLS.index(c) // len(FAULTS)] for c in seq)
        self.counts[3] += sum(roles[k:k + 2] not in ("su", "ua", "au") for k in range(len(roles) - 1))
        self.last = roles[-1]

    def ended(self):
        """(chunk, state before it, edits in it) of the chosen path, and the cost."""
        ends = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        cost, _, end, node = min((v[0] + INSERT * len(ends[s]), v[1], ends[s], v[2]) for s, v in enumerate(self.vector) if v)
        path = []
        while node:
            node, chunk, state, audit = node
            path.append((chunk, state, audit + ("" if path else end)))
        return path[::-1], cost


def chosen(matrices: DataFrame) -> DataFrame:
    """conv, chunk, state and audit of each piece on its conversation's cheapest path;
    the first piece also carries the cost and the counts of faults."""

    def run(batches):
        conv, own, some, kind = None, None, False, None

        def close():
            path, cost = own.ended()
            out = [(conv, c, s, a, cost if not k else None, *(own.counts if not k else [None] * 4)) for k, (c, s, a) in enumerate(path)]
            for lo in range(0, len(out), 1000):
                yield _batch(out[lo:lo + 1000], kind, CHOSEN)

        for batch in batches:
            kind = batch.column(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not some or row[0] != conv:
                    if some:
                        yield from close()
                    conv, own, some = row[0], _Joined(), True
                own.add(*row[1:])
        if some:
            yield from close()

    id_type = dict(matrices.dtypes)["conv"]
    dealt = matrices.repartition("conv").sortWithinPartitions("conv", "chunk").select("conv", "chunk", "seq", "cost", "rank", "audit")
    return dealt.mapInArrow(run, f"conv {id_type}, chunk long, state int, audit string, cost long, blank long, duplicate long, truncated long, illegal long")


CHOSEN = {"chunk": pa.int64(), "state": pa.int32(), "audit": pa.string(), **dict.fromkeys(("cost", "blank", "duplicate", "truncated", "illegal"), pa.int64())}
RESULT = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}


def _batch(rows: list[tuple], kind: pa.DataType, columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows whose first value is the conversation's id."""
    named = {"conv": kind, **columns}
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), named.values(), strict=True)], names=list(named))


class _Repaired:
    """A conversation's rows streamed past its edits."""

    def __init__(self) -> None:
        self.digest, self.begun = hashlib.sha256(), False
        self.audit: list[str] = []
        self.edits, self.at, self.state = "", 0, START
        self.totals = [0] * 5
        self.low = self.high = self.turn = None
        self.turns = 0

    def emit(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.begun = True

    def inserted(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.emit("assistant" if self.state == USER else "user", "")
            self.state = turned(self.state)
            self.at += 1

    def piece(self, state: int, audit: str, totals: list) -> None:
        self.inserted()
        self.edits, self.at, self.state = audit, 0, state
        self.audit.append(audit)
        if totals[0] is not None:
            self.totals = totals

    def row(self, turn, role: str, text: str) -> None:
        self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.emit(role, text)
            self.state = kept(self.state, role[:1])
        elif edit == "R":
            self.emit("assistant" if self.state == USER else "user", text)
            self.state = turned(self.state)
        if turn is not None:  # turns come in order
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn

    def result(self, conv) -> tuple:
        self.inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, *counts = self.totals
        return (conv, gaps, *counts, cost, "".join(self.audit), self.digest.hexdigest())


def repair(conversations: DataFrame, rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each id of ``conversations``: the repair of its rows in ``rows``
    (conv, turn, role, text)."""
    placed = ordered(rows)
    pieces = cut(pieces_of(symbols(placed)))
    headers = chosen(evaluated(pieces, learn(pieces)))
    ids = conversations.select(F.col(conv).alias("conv")).distinct()
    stream = ids.unionByName(headers, allowMissingColumns=True).unionByName(placed.select("conv", "chunk", "at", F.col("turn").cast("long").alias("turn"), "role", "text"), allowMissingColumns=True)

    def run(batches):
        conv, own, some, kind, out = None, None, False, None, []
        for batch in batches:
            kind = batch.column(0).type
            for key, chunk, at, turn, role, text, state, audit, *totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not some or key != conv:
                    if some:
                        out.append(own.result(conv))
                    conv, own, some = key, _Repaired(), True
                if at is not None:
                    own.row(turn, role, text)
                elif chunk is not None:
                    own.piece(state, audit, totals)
                if len(out) >= 1000:
                    yield _batch(out, kind, RESULT)
                    out = []
        if some:
            yield _batch([*out, own.result(conv)], kind, RESULT)

    names = ["conv", "chunk", "at", "turn", "role", "text", "state", "audit", "cost", "blank", "duplicate", "truncated", "illegal"]
    id_type = dict(ids.dtypes)["conv"]
    dealt = stream.select(*names).repartition("conv").sortWithinPartitions("conv", "chunk", "at")
    return dealt.mapInArrow(run, f"conv {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The repair of the conversations after ``damaged``."""
    return repair(conversations, damaged(conversations, conv), conv).withColumnRenamed("conv", conv)
