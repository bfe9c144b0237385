"""Repair of conversation structure: cheapest edits by a dynamic programme over a grammar of the fault sequences.

A row is one of nine symbols: must be deleted (blank or a duplicate), or the class of its role (system, user, assistant,
other), truncated or not. The programme walks an automaton of four states (nothing yet, after a system row, after a user
row, after an assistant row), and what a symbol does to it is a 4 x 4 matrix over (min, +): for each pair of states the
cheapest edits, as a cost and an audit string. Inserted rows are put in front of the next row that is not inserted, so
that of two audits of one entry none begins the other, and the least of joined audits is made of the least of their parts.

Re-Pair replaces the most frequent pair of neighbours by a new symbol again and again, over all distinct sequences of a
batch of conversations; each rule has its matrix computed once, bottom-up, for all conversations that use it. Audits
are ropes: a rule's audit is two references, and two ropes are compared by hashes of their parts.

Rows are put in ranges of (conversation, turn, role, text), so that a conversation of a third of all rows spreads over many
tasks. What lies within one task is solved there. A conversation that meets the border of a task is cut into chunks; a
chunk gives its matrix, the matrices of a conversation are multiplied in order, and each chunk gets back its part
of the audit. Only the digest runs through a conversation's chunks one after the other, as SHA-256 does, one chunk in
memory at a time. The audit of a conversation, a character for each row, is held whole, as it is one value of the result.

Null role or text is one space. Rows are taken by turn, nulls first, equal turns by role and text; equal rows are
counted and not repeated. A null conv_id is a conversation of its own. Columns of other names are ignored. An empty table
gives no rows; a conversation without rows (``copies`` 0) gives zeros, no audit and the digest of the empty text. Gaps beyond
a long are cut off at its largest value.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import shuffle_partitions, staged

# Fixed values of the edit costs, and the white space of this package.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Rows and characters of a chunk.
CHUNK_ROWS, CHUNK_TEXT = 4096, 1 << 20

#: Where a kept row of a role's initial leads from each state, and what an inserted or changed row becomes there.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """A string as a tree, with its length and a hash of its characters."""

    __slots__ = ("length", "hash", "power", "text", "left", "right")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.length, self.power = left.length + right.length, left.power * right.power % _MOD
            self.hash = (left.hash * right.power + right.hash) % _MOD
        else:
            self.length, self.power, self.hash = len(text), pow(_BASE, len(text), _MOD), 0
            for c in text:
                self.hash = (self.hash * _BASE + ord(c)) % _MOD

    def __add__(self, other: Rope) -> Rope:
        if not self.length or not other.length:
            return self if self.length else other
        return Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        mine, theirs = [self], [other]
        while mine and theirs:
            x, y = mine.pop(), theirs.pop()
            if x.length == y.length and x.hash == y.hash:
                continue
            if x.text is not None and y.text is not None:
                n = min(x.length, y.length)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                if x.length > n:
                    mine.append(Rope(x.text[n:]))
                if y.length > n:
                    theirs.append(Rope(y.text[n:]))
            elif x.text is None and (y.text is not None or x.length >= y.length):
                mine += [x.right, x.left]
                theirs.append(y)
            else:
                theirs += [y.right, y.left]
                mine.append(x)
        return bool(theirs)

    def __str__(self) -> str:
        out, rest = [], [self]
        while rest:
            node = rest.pop()
            if node.text is None:
                rest += [node.right, node.left]
            else:
                out.append(node.text)
        return "".join(out)


Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def _better(found: Entry | None, cost: int, audit: Rope) -> bool:
    return found is None or cost < found[0] or cost == found[0] and audit < found[1]


def step(vector: list[Entry | None], matrix: Matrix) -> tuple[list[Entry | None], list[int | None]]:
    """``vector`` moved on by ``matrix`` over (min, +), and the state that each new entry came from."""
    out, came = [None] * 4, [None] * 4
    for i in STATES:
        if (a := vector[i]) is not None:
            for j in STATES:
                if (b := matrix[i][j]) is not None and (out[j] is None or a[0] + b[0] <= out[j][0]):
                    cost, audit = a[0] + b[0], a[1] + b[1]
                    if _better(out[j], cost, audit):
                        out[j], came[j] = (cost, audit), i
    return out, came


def product(a: Matrix, b: Matrix) -> Matrix:
    return [step(row, b)[0] for row in a]


def inserts() -> Matrix:
    """Inserted rows alone: none, one or two."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        at = i
        for n in range(3):
            if out[i][at] is None:
                out[i][at] = (n * INSERT, Rope("I" * n))
            at = NEXT[at]
    return out


def terminal(symbol: str) -> Matrix:
    """Inserted rows, then one row: ``x`` must go, else the class of its role, a capital letter where it is truncated."""
    row: Matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        row[i][i] = (DELETE, Rope("D"))
        if symbol != "x":
            more = TRUNCATED * symbol.isupper()
            row[i][NEXT[i]] = (REROLE + more, Rope("R"))
            if (kept := KEPT.get(symbol.lower(), {}).get(i)) is not None:
                row[i][kept] = (more, Rope("K"))
    return product(inserts(), row)


TERMINALS = {c: terminal(c) for c in "suaoSUAOx"}
FINAL = inserts()
NOTHING: list[Entry | None] = [(0, Rope("")), None, None, None]


def re_pair(sequences: list[list]) -> tuple[list[tuple], list[list]]:
    """Rules (pairs of symbols; rule k is the symbol k) and the sequences written with them."""
    symbols, before, after = [], [], []
    for sequence in sequences:
        for i, x in enumerate([*sequence, None]):  # None parts the sequences
            symbols.append(x)
            before.append(len(symbols) - 2 if i else -1)
            after.append(len(symbols) if i < len(sequence) else -1)
    places: dict[tuple, set[int]] = defaultdict(set)

    def note(i: int, put: bool) -> tuple | None:
        if i < 0 or after[i] < 0 or symbols[after[i]] is None:
            return None
        pair = symbols[i], symbols[after[i]]
        (places[pair].add if put else places[pair].discard)(i)
        return pair

    for i in range(len(symbols)):
        note(i, True)
    order = {}  # pairs in order of their first place, so that ties are settled alike everywhere
    queue = [(-len(at), order.setdefault(pair, len(order)), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(queue)
    rules: list[tuple] = []
    while queue:
        n, _, pair = heapq.heappop(queue)
        if len(places[pair]) != -n:
            if len(places[pair]) > 1:
                heapq.heappush(queue, (-len(places[pair]), order[pair], pair))
            continue
        new, changed = len(rules), {}
        rules.append(pair)
        for i in sorted(places.pop(pair)):
            j = after[i]
            if j < 0 or (symbols[i], symbols[j]) != pair:  # part of a replaced pair by now
                continue
            h, k = before[i], after[j]
            note(h, False)
            note(j, False)
            symbols[i], symbols[j], after[i], after[j] = new, None, k, -1
            before[k] = i
            for p in (note(h, True), note(i, True)):
                if p is not None:
                    changed[p] = None
        for p in changed:
            if len(places[p]) > 1:
                heapq.heappush(queue, (-len(places[p]), order.setdefault(p, len(order)), p))
    out, at = [], 0
    for sequence in sequences:
        i, short = at, []
        while symbols[i] is not None:
            short.append(symbols[i])
            i = after[i]
        out.append(short)
        at += len(sequence) + 1
    return rules, out


def compressed(sequences: list[str]) -> list[list[Matrix]]:
    """The matrices whose product is that of each sequence: one for each symbol of its grammar-compressed form."""
    rules, short = re_pair([list(s) for s in sequences])
    matrices: dict = dict(TERMINALS)
    for k, (left, right) in enumerate(rules):
        matrices[k] = product(matrices[left], matrices[right])
    return [[matrices[x] for x in s] for s in short]


def solve(sequences: list[str]) -> dict[str, tuple[int, str]]:
    """Cost and audit of each distinct sequence of symbols."""
    distinct = list(dict.fromkeys(sequences))
    out = {}
    for sequence, matrices in zip(distinct, compressed(distinct)):
        vector = NOTHING
        for matrix in matrices:
            vector, _ = step(vector, matrix)
        cost, audit, _ = finished(vector)
        out[sequence] = cost, str(audit)
    return out


def finished(vector: list[Entry | None]) -> tuple[int, Rope, int]:
    """Cost and audit with the last inserts, and the state that they begin in."""
    ends, came = step(vector, FINAL)
    state = START if ends[ASSISTANT] is None or ends[START] is not None and not _better(ends[START], *ends[ASSISTANT]) else ASSISTANT
    return *ends[state], came[state]


def symbol_of(role: str, text: str, again: bool) -> str:
    """x, or s, u, a, o for the role, capital if the text is truncated. ``again``: the row was seen earlier."""
    shown = text.rstrip(SPACE)
    if not shown or again:
        return "x"
    kind = role[:1] if role[:1] in KEPT else "o"
    return kind if shown[-1] in ENDS else kind.upper()


def edited(rows: list[tuple[str, str, int]], audit: str, state: int) -> tuple[list[str], int]:
    """``role:text`` of the rows that the audit leaves or inserts, and the state after them."""
    out, at, left = [], 0, rows[0][2] if rows else 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append(ROLE[state] + ":")
            continue
        while not left:
            at += 1
            left = rows[at][2]
        left -= 1
        role, text, _ = rows[at]
        if edit == "K":
            state = KEPT[role[0]][state]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:{text}")
    return out, state


CHUNK = ("conv_id long, part long, no long, whole boolean, symbols string, roles array<string>, texts array<string>, copies array<long>, "
         "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, size long")
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
_CHUNK = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("no", pa.int64()), ("whole", pa.bool_()), ("symbols", pa.string()),
                    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())),
                    *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()),
                    ("last", pa.string()), *((c, pa.int64()) for c in ("low", "high", "turns", "size"))])
_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Chunk:
    """Rows of one conversation in order, and what is counted over them."""

    def __init__(self, conv_id: int | None):
        self.row = {"conv_id": conv_id, "roles": [], "texts": [], "copies": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                    "first": None, "last": None, "low": None, "high": None, "turns": 0}
        self.symbols: list[str] = []
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        if not copies:
            return
        row, symbol, initial = self.row, symbol_of(role, text, again), role[:1]
        self.symbols.append(symbol + "x" * (copies - 1))
        blank = not text.strip(SPACE)
        row["blank"] += copies * blank
        row["duplicate"] += (copies - 1 + again) * (not blank)
        row["truncated"] += symbol.isupper()
        row["illegal"] += copies - 1 + (row["last"] is not None and row["last"] + initial not in LEGAL)
        row["first"] = initial if row["first"] is None else row["first"]
        row["last"] = initial
        if turn is not None:
            row["turns"] += turn != row["high"]
            row["low"] = turn if row["low"] is None else row["low"]
            row["high"] = turn
        row["roles"].append(role)
        row["texts"].append(text)
        row["copies"].append(copies)
        self.size += len(text) + copies

    def full(self) -> bool:
        return len(self.symbols) >= CHUNK_ROWS or self.size >= CHUNK_TEXT


def chunks(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies, again) in order, as chunks in the shared folder."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]

    def run(batches):
        part, no, chunk, inner = TaskContext.get().partitionId(), 0, None, False  # inner: the conversation began here
        out, size = [], 0

        def closed(whole: bool) -> dict:
            nonlocal no, size
            no += 1
            size += chunk.size
            return chunk.row | {"part": part, "no": no, "whole": whole, "symbols": "".join(chunk.symbols), "size": chunk.size}

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for conv_id, turn, role, text, copies, again in zip(*columns):
                if chunk is None or chunk.row["conv_id"] != conv_id:
                    if chunk is not None:
                        out.append(closed(inner))
                        inner = True
                    chunk = _Chunk(conv_id)
                elif chunk.full():
                    out.append(closed(False))
                    chunk, inner = _Chunk(conv_id), False
                chunk.add(turn, role, text, copies, again)
            if size > 4 << 20 or len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=_CHUNK)
                out, size = [], 0
        if chunk is not None:
            out.append(closed(False))
            yield pa.RecordBatch.from_pylist(out, schema=_CHUNK)

    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return staged(ranged.mapInArrow(run, CHUNK), "conversation-chunks")


def _rows(chunk: dict) -> list[tuple[str, str, int]]:
    return list(zip(chunk["roles"], chunk["texts"], chunk["copies"]))


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


def _parts(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of chunks of up to ``most`` characters in all."""
    for batch in batches:
        start = total = 0
        for i, n in enumerate(batch.column(batch.schema.get_field_index("size")).to_pylist()):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of whole conversations."""
    for batch in _parts(batches):
        found, out = batch.to_pylist(), []
        answers = solve([c["symbols"] for c in found])
        for c in found:
            cost, audit = answers[c["symbols"]]
            text = "\n".join(edited(_rows(c), audit, START)[0])
            out.append(c | {"gaps": _gaps(c["low"], c["high"], c["turns"]), "cost": cost, "audit": audit,
                            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=_RESULT)


def chunk_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of each chunk, as JSON."""
    for batch in batches:
        sequences = batch.column(batch.schema.get_field_index("symbols")).to_pylist()
        distinct = list(dict.fromkeys(sequences))
        as_text = {}
        for sequence, matrices in zip(distinct, compressed(distinct)):
            total: Matrix = [[(0, Rope("")) if i == j else None for j in STATES] for i in STATES]
            for matrix in matrices:
                total = product(total, matrix)
            as_text[sequence] = json.dumps([[e and [e[0], str(e[1])] for e in row] for row in total])
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "part", "no")),
                                          pa.array([as_text[s] for s in sequences], type=pa.string())], names=["conv_id", "part", "no", "matrix"])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each chunk, and the state that it begins in, from the matrices of its conversation in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("no", pa.int64()), ("edits", pa.string()), ("state", pa.int32()),
                        ("cost", pa.int64())])
    for rows in _conversations(batches):
        matrices = [[[e and (e[0], Rope(e[1])) for e in row] for row in json.loads(r["matrix"])] for r in rows]
        vector, came = NOTHING, []
        for matrix in matrices:
            vector, back = step(vector, matrix)
            came.append(back)
        cost, _, state = finished(vector)
        end = "" if state == START else str(FINAL[state][ASSISTANT][1])
        out = []
        for row, matrix, back in reversed(list(zip(rows, matrices, came))):
            was = back[state]
            out.append({k: row[k] for k in ("conv_id", "part", "no")} | {"edits": str(matrix[was][state][1]) + end, "state": was, "cost": cost})
            state, end = was, ""
        yield pa.RecordBatch.from_pylist(out[::-1], schema=schema)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose chunks come in order with their edits; one chunk is held at a time."""
    total, digest, audit, lines = None, None, [], 0

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([total | {"gaps": _gaps(total["low"], total["high"], total["turns"]), "audit": "".join(audit),
                                                    "repaired_sha256": digest.hexdigest()}], schema=_RESULT)

    for batch in batches:
        for at in range(batch.num_rows):
            c = batch.slice(at, 1).to_pylist()[0]
            if total is None or total["conv_id"] != c["conv_id"]:
                if total is not None:
                    yield result()
                total = {k: c[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "last", "low", "high", "turns", "cost")}
                digest, audit, lines = hashlib.sha256(), [], 0
            else:
                for k in ("blank", "duplicate", "truncated", "illegal"):
                    total[k] += c[k]
                if total["last"] is not None and c["first"] is not None:
                    total["illegal"] += total["last"] + c["first"] not in LEGAL
                total["turns"] += c["turns"] - (c["low"] is not None and c["low"] == total["high"])
                total["low"] = c["low"] if total["low"] is None else total["low"]
                total["high"] = total["high"] if c["high"] is None else c["high"]
                total["last"] = total["last"] if c["last"] is None else c["last"]
            audit.append(c["edits"])
            for line in edited(_rows(c), c["edits"], c["state"])[0]:
                digest.update((b"\n" if lines else b"") + line.encode())
                lines += 1
    if total is not None:
        yield result()


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text; ``copies``: how often a row counts, 0 for not):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copies.alias("copies"))
    # equal rows become one with a count, on the map side first; what is dropped stays as a count of 0
    distinct = (plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
                .withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    first = (distinct.where("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"))
             .agg(F.min("turn").alias("_first"), F.max(F.col("turn").isNull()).alias("_null"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    seen = distinct.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_first"))), F.lit(False))
    cut = chunks(seen.select("conv_id", "turn", "role", "text", "copies", again.alias("again")))
    inside = cut.where("whole").mapInArrow(solved, RESULT)

    spark = rows.sparkSession
    border, order, n = cut.where("not whole"), ["conv_id", "part", "no"], shuffle_partitions(spark)
    matrices = border.select(*order, "symbols").mapInArrow(chunk_matrices, "conv_id long, part long, no long, matrix string")
    share = (matrices.repartition(n, "conv_id").sortWithinPartitions(*order)
             .mapInArrow(shares, "conv_id long, part long, no long, edits string, state int, cost long"))
    share = share.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("no").alias("_no"), "edits", "state", "cost")
    both = border.join(share, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("no") == F.col("_no")))
    across = both.drop("_conv", "_part", "_no").repartition(n, "conv_id").sortWithinPartitions(*order).mapInArrow(joined, RESULT)
    return inside.unionByName(across)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the faults that crc32 of ``conv_id:turn`` deals out: copies 0 (dropped), 2 (repeated) or 1."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
                       F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
