"""Packing token ids into windows of equal length by minimum bin slack.

Every document becomes whole windows and a rest shorter than a window. What is left to pack is then a multiset of
lengths below the window, whatever the size of the corpus: at most CAPACITY - 1 counts. For each window the longest
rest is set first, and a subset-sum over a bitset (bit s: some choice of the others sums to s) finds the multiset that
comes closest to the capacity; the counts are read back from the layers of the bitset. The same choice is made as often
as the counts allow, so that the number of choices does not grow with the corpus either. Slack that no multiset fills is
filled by cutting one more rest, whose end goes back into the multiset. What remains at the very end, less than one
window, is cut at powers of two, which need no padding.

The choices speak of ranks: "rests of length 700, number 1,200 to 1,499, into windows 81,000 and on". A rest's rank is its
place in its input split plus the rests of that length in the splits before it, so that no length is ever gathered in
one task, however many rests have it.

Null text is an empty text: its end id alone. A null doc_id stays null, and every row is a document of its own, repeated
or not. Other columns are ignored. An empty table gives no pieces. Which documents share a window depends on how the
input is split into tasks; lengths of sequences do not.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.llm.common import pieces, staged, tidy
from seriesloom.llm.tokenfile import PIECE, WORD_BPE, word_encoder

CAPACITY = 2048
END = 1
#: Cut rests up to this number are broadcast to fetch their ids; beyond it Spark joins by shuffle.
FEW = 50_000

ITEMS = "slice long, length int, place long, doc_id long, start long, doc_tokens long, ids_crc32 long, ids binary"
PLACEMENTS = "length int, from_rank long, to_rank long, skip int, take int, sequence long, turn long, uses int, at int"


class Placement(NamedTuple):
    """Rests of ``length`` from one rank to another: ``take`` ids of each, after ``skip``, go to ``uses`` slots of each
    sequence from ``sequence`` on, the first of them to slot number ``turn``; slot 0 lies at offset ``at``."""

    length: int
    from_rank: int
    to_rank: int
    skip: int
    take: int
    sequence: int
    turn: int
    uses: int
    at: int


def closest(stock: dict[int, int], room: int) -> dict[int, int]:
    """Number of uses of each length, no more than in stock, whose sum comes closest to ``room`` from below."""
    mask, reach = (1 << (room + 1)) - 1, 1
    layers: list[tuple[int, int, int]] = []
    for length in sorted((x for x, n in stock.items() if n and x <= room), reverse=True):
        left, step = min(stock[length], room // length), 1
        while left and not reach >> room & 1:
            step = min(step, left)
            layers.append((length, step, reach))
            reach |= reach << step * length & mask
            left, step = left - step, 2 * step
    at, uses = reach.bit_length() - 1, defaultdict(int)
    for length, step, before in reversed(layers):
        if not before >> at & 1:
            uses[length] += step
            at -= step * length
    return dict(uses)


class _Rests:
    """The multiset: for each length, runs of ranks of the rests (or of their ends) that are not placed yet."""

    def __init__(self, counts: dict[int, int]):
        self.stock = {x: n for x, n in counts.items() if n}
        self.runs = {x: deque([(x, 0, n, 0)]) for x, n in self.stock.items()}

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        """Runs (length of the whole rest, first rank, number, ids before) of n pieces of this length."""
        self.stock[length] -= n
        if not self.stock[length]:
            del self.stock[length]
        out = []
        while n:
            whole, first, there, skip = self.runs[length].popleft()
            if there > n:
                self.runs[length].appendleft((whole, first + n, there - n, skip))
                there = n
            out.append((whole, first, there, skip))
            n -= there
        return out

    def put(self, length: int, run: tuple[int, int, int, int]) -> None:
        self.stock[length] = self.stock.get(length, 0) + run[2]
        self.runs.setdefault(length, deque()).append(run)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], list[tuple[int, int]]]:
    """Where rests go, and the sequences made: (number, length), in order. ``counts``: rests of each length."""
    rests, out, made = _Rests(counts), [], []
    sequence = 0

    def place(length: int, uses: int, windows: int, at: int, take: int) -> list[tuple[int, int, int, int]]:
        turn, runs = 0, rests.take(length, uses * windows)
        for whole, first, n, skip in runs:
            out.append(Placement(whole, first, first + n, skip, take, sequence, turn, uses, at))
            turn += n
        return runs

    while stock := rests.stock:
        largest = max(stock)
        uses = closest({**stock, largest: stock[largest] - 1}, capacity - largest)
        uses[largest] = uses.get(largest, 0) + 1
        filled = sum(x * n for x, n in uses.items())
        if filled < capacity and all(stock[x] == uses.get(x, 0) for x in stock):
            break  # less than a window is left
        cut = max((x for x in stock if stock[x] > uses.get(x, 0)), default=0) if filled < capacity else 0
        windows = min(stock[x] // (n + (x == cut)) for x, n in uses.items())
        if cut:
            windows = min(windows, stock[cut] // (uses.get(cut, 0) + 1))
        at = 0
        for length in sorted(uses, reverse=True):
            place(length, uses[length], windows, at, length)
            at += length * uses[length]
        if cut:
            for whole, first, n, skip in place(cut, 1, windows, at, capacity - at):
                rests.put(cut - capacity + at, (whole, first, n, skip + capacity - at))
        sequence += windows
        made.append((windows, capacity))

    left = [[*run, length] for length in sorted(rests.stock, reverse=True) for run in rests.take(length, rests.stock[length])]
    last = deque([whole, first + i, skip, length] for whole, first, n, skip, length in left for i in range(n))
    total = sum(x[3] for x in last)
    for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        at = 0
        while at < size:
            whole, rank, skip, length = last.popleft()
            take = min(length, size - at)
            out.append(Placement(whole, rank, rank + 1, skip, take, sequence, 0, 1, at))
            if take < length:
                last.appendleft([whole, rank, skip + take, length - take])
            at += take
        sequence += 1
        made.append((1, size))
    return out, made


def items(docs: DataFrame, path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Whole windows and the rest of each document, encoded and staged: slice (the task that wrote them), length,
    place among the items of this length in the slice, doc_id, start, doc_tokens, ids_crc32, ids (little-endian uint32)."""
    path = path or public_tokenizers.path(WORD_BPE)
    tail = np.array([end], dtype="<u4").tobytes()
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in ITEMS.split(", ")]

    def run(batches):
        number, places = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                rows, held = [], 0
                for doc_id, ids in zip(part.column(0).to_pylist(), word_encoder(path).encode(part.column(1).to_pylist())):
                    ids += tail
                    for start in range(0, len(ids), 4 * capacity):
                        piece = ids[start:start + 4 * capacity]
                        length = len(piece) // 4
                        rows.append((number, length, places[length], doc_id, start // 4, len(ids) // 4, zlib.crc32(piece), piece))
                        places[length] += 1
                        held += len(piece)
                        if held > 4 << 20:
                            yield as_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], names=names)

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return staged(texts.mapInArrow(tidy(run), ITEMS), "packing-items")


def placed(some: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Pieces of the items and their sequences: slice, length, place (these name the item), doc_id, start, skip, take,
    doc_tokens, ids_crc32 (of the item), sequence_id, offset; and the number of pieces of items that are cut."""
    counts = some.groupBy("slice", "length").agg(F.count(F.lit(1)).alias("n"))
    of_all = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row for each length, at most ``capacity``
    placements, _ = plan({r["length"]: r["n"] for r in of_all}, capacity)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    where = some.sparkSession.createDataFrame(placements, PLACEMENTS).withColumnRenamed("length", "of")
    spots = ranked.join(where, (F.col("length") == F.col("of")) & (F.col("base") < F.col("to_rank"))
                        & (F.col("base") + F.col("n") > F.col("from_rank"))).drop("of", "n")
    rank = F.col("base") + F.col("place")
    found = (some.drop("ids").join(spots, ["slice", "length"])
             .where((rank >= F.col("from_rank")) & (rank < F.col("to_rank")))
             .withColumn("turn", F.col("turn") + rank - F.col("from_rank")))
    n_cut = sum(p.to_rank - p.from_rank for p in placements if p.take < p.length)
    return found.select("slice", "length", "place", "doc_id", "start", "skip", "take", "doc_tokens", "ids_crc32",
                        (F.col("sequence") + F.floor(F.col("turn") / F.col("uses"))).alias("sequence_id"),
                        (F.col("at") + F.col("turn") % F.col("uses") * F.col("take")).cast("long").alias("offset")), n_cut


def pack(docs: DataFrame, path: str | None = None, end: int = END, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) and, lazily, the packed sequences
    (sequence_id, n_tokens, ids). A sequence shorter than ``capacity`` has a power of two as its length."""
    some = items(docs, path, end, capacity)
    found, n_cut = placed(some, capacity)
    found = staged(found, "packing-pieces")
    whole = found.where(F.col("take") == F.col("length"))
    cut = found.where(F.col("take") < F.col("length")).drop("ids_crc32")
    part = F.expr("substring(ids, 4 * skip + 1, 4 * take)")
    key = ["slice", "length", "place"]
    cut = some.select(*key, "ids").join(F.broadcast(cut) if n_cut <= FEW else cut, key).withColumn("ids_crc32", F.crc32(part))
    out = whole.unionByName(cut.select(*whole.columns)).select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("take").cast("long").alias("length"), "ids_crc32",
        "doc_tokens", "sequence_id", "offset")
    filled = (found.drop("ids_crc32").join(some.select(*key, "ids"), key)
              .groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", part.alias("ids")))).alias("parts"))
              .select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (x, p) -> concat(x, p.ids))").alias("ids")))
    return out, filled.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def packed_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(docs, path)[0]
