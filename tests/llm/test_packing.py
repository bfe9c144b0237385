import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm import packing
from seriesloom.llm.tokenfile import WORD_BPE


def test_closest_equals_all_subsets():
    rnd = random.Random(3)
    for _ in range(300):
        room = rnd.randint(1, 40)
        stock = Counter(rnd.randint(1, 20) for _ in range(rnd.randint(0, 9)))
        parts = list(stock.elements())
        best = max(s for k in range(len(parts) + 1) for c in itertools.combinations(parts, k) if (s := sum(c)) <= room)
        uses = packing.closest(stock, room)
        assert sum(x * n for x, n in uses.items()) == best
        assert all(0 < n <= stock[x] for x, n in uses.items())


def check(counts, capacity):
    """Every id of every rest in one slot, every slot of every sequence filled; returns the number of cuts."""
    placements, made = packing.plan(counts, capacity)
    sizes = [size for n, size in made for _ in range(n)]
    slots, ids, cuts = defaultdict(list), defaultdict(list), 0
    for p in placements:
        cuts += (p.take < p.length) * (p.to_rank - p.from_rank)
        for rank in range(p.from_rank, p.to_rank):
            turn = p.turn + rank - p.from_rank
            slots[p.sequence + turn // p.uses].append((p.at + turn % p.uses * p.take, p.take))
            ids[p.length, rank].append((p.skip, p.take))
    assert sorted(slots) == list(range(len(sizes)))
    assert set(ids) == {(x, r) for x, n in counts.items() for r in range(n)}
    for runs, size in [(slots[s], size) for s, size in enumerate(sizes)] + [(v, k[0]) for k, v in ids.items()]:
        at = 0
        for start, n in sorted(runs):
            assert start == at and n > 0
            at += n
        assert at == size
    assert all(size == capacity for _, size in made[:-capacity.bit_length()])
    assert all(size == capacity or size & (size - 1) == 0 for size in sizes)
    return cuts


def test_plans_place_every_id_once_without_padding():
    rnd = random.Random(4)
    for capacity in (16, 64):
        for _ in range(40):
            check(Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(0, 200))), capacity)
        check({capacity: 7, 1: 1000}, capacity)
        check({capacity - 3: 1001}, capacity)
    assert check(Counter(rnd.randint(1, 700) for _ in range(20_000)), 2048) < 40  # short rests stay whole


def test_a_plan_does_not_grow_with_the_corpus():
    rnd = random.Random(5)
    counts = Counter(rnd.randint(1, 2047) for _ in range(20_000))
    small, _ = packing.plan(counts)
    large, _ = packing.plan({x: 100_000 * n + x for x, n in counts.items()})
    assert len(large) < 3 * len(small)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_of_odd_rows(odd_docs, no_docs, capacity):
    library = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    want = Counter()
    for r in odd_docs.select("doc_id", "text").collect():
        want[r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids + [packing.END])] += 1
    extra = odd_docs.withColumn("slice", F.lit("x")).withColumn("length", F.lit(1.5)).withColumn("ids", F.lit(0))
    found, sequences = packing.pack(extra, capacity=capacity)
    packed = {r["sequence_id"]: np.frombuffer(r["ids"], dtype="<u4") for r in sequences.collect()}
    parts, covered = defaultdict(list), defaultdict(int)
    for r in found.collect():
        ids = packed[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(ids.tolist())))
        covered[r["sequence_id"]] += r["length"]
    assert covered == {s: len(x) for s, x in packed.items()}
    assert all(len(x) == capacity or len(x) & (len(x) - 1) == 0 for x in packed.values()) and all(len(x) <= capacity for x in packed.values())
    documents = Counter()
    for (doc_id, n), found_parts in parts.items():
        copies = sum(len(p) for _, p in found_parts) // n
        by_start = defaultdict(list)
        for start, p in found_parts:
            by_start[start].append(p)
        for k in range(copies):  # equal documents in this table: any of their pieces will do
            at, whole = 0, ()
            while at < n:
                options = by_start[at]
                p = options.pop(0)
                whole += p
                at += len(p)
            documents[doc_id, whole] += 1
    assert documents == want
    assert packing.packed_pieces(no_docs).count() == 0


def test_documents_in_bulk_need_few_cuts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = packing.packed_pieces(docs).toPandas()
    sizes = found.groupby("sequence_id")["length"].sum()
    assert found["length"].sum() == found.groupby("doc_id")["doc_tokens"].first().sum()
    assert ((sizes == 2048) | (sizes & (sizes - 1) == 0)).all() and (sizes < 2048).sum() <= 11
    first = found[found["start"] % 2048 != 0]
    assert len(first) < 0.2 * found["doc_id"].nunique()  # pieces that begin within a window of their document
