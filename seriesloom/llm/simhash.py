"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by their rank in Gray order, in which neighbours share most bits. The upper nodes of
the index are patterns of masked bits: the 64 bits are cut into ``bits + 1`` blocks, and two fingerprints at a distance
of at most ``bits`` agree on a whole block, so each fingerprint belongs to one node for each block and every link lies
below a common node. These nodes are spread over the cluster; one with more than SPLIT fingerprints is split by blocks
of its other bits in the same way. Below a node, runs of fingerprints in Gray order form groups, and groups of groups,
that store the bits all members agree on. Two groups are compared by the differences of their shared bits: more than
``bits`` drop all pairs below at once, and if the bits not shared cannot exceed ``bits`` either, all pairs link at once.
A node hands on only one link for each fingerprint to its component there, never all pairs.

Null text has no words; its fingerprint is zero and links like any other. A null doc_id never names a component
unless all ids of the component are null. Repeated rows share a fingerprint. Columns named fingerprint or component_id
are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import pieces, shuffle_partitions, staged, text_bytes, tidy
from seriesloom.llm.components import components

SHINGLE, BITS, SEED = 4, 4, 42
#: Fingerprints below one upper node before it is split; groups of the local index.
SPLIT, GROUP = 50_000, 32
_ONE = np.uint64(1)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of all shingles of a text's words, A-Z lower-cased."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths).tolist(), ends[shingle - 1:].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """``docs`` with _fp, the fingerprint as a long of the same bits."""
    docs = docs.drop("_fp")
    schema = T.StructType([f for f in docs.schema if keep_text or f.name != "text"] + [T.StructField("_fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                at = part.schema.get_field_index("text")
                found = np.array([fingerprint(x, shingle) for x in text_bytes(part.column(at))], dtype=np.uint64)
                columns = [part.column(i) for i in range(part.num_columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def blocks(places: list[int], n: int) -> list[int]:
    """Masks that cut the given bits into n blocks of even size."""
    cuts = [len(places) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in places[a:z]) for a, z in zip(cuts, cuts[1:])]


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order, as a long that sorts like the unsigned number."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def below_nodes(codes: DataFrame, bits: int = BITS, split: int = SPLIT) -> DataFrame:
    """_fp under each of its upper nodes: _m, _p (block and its bits), _m2, _p2 (the same below a split node, else -1, 0)."""
    masks = blocks(list(range(64)), bits + 1)
    node = F.array(*[F.struct(F.lit(k).alias("_m"), F.col("_fp").bitwiseAND(F.lit(as_long(m))).alias("_p")) for k, m in enumerate(masks)])
    placed = codes.select("_fp", F.explode(node).alias("n")).select("_fp", "n._m", "n._p")
    large = placed.groupBy("_m", "_p").count().where(F.col("count") > split).select("_m", "_p", F.lit(True).alias("_large"))
    placed = placed.join(large, ["_m", "_p"], "left")
    second = None
    for k, m in enumerate(masks):
        rest = blocks([b for b in range(64) if not m >> b & 1], bits + 1)
        inner = F.array(*[F.struct(F.lit(j).alias("_m2"), F.col("_fp").bitwiseAND(F.lit(as_long(r))).alias("_p2")) for j, r in enumerate(rest)])
        second = F.when(F.col("_m") == k, inner) if second is None else second.when(F.col("_m") == k, inner)
    alone = F.array(F.struct(F.lit(-1).alias("_m2"), F.lit(0).cast("long").alias("_p2")))
    return (placed.select("_fp", "_m", "_p", F.explode(F.when(F.col("_large"), second).otherwise(alone)).alias("n"))
            .select("_fp", "_m", "_p", "n._m2", "n._p2"))


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of each pair; labels are least members."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def links(codes: np.ndarray, bits: int) -> np.ndarray:
    """Component of each of the codes (uint64, distinct, in Gray order): the place of its first member."""
    n = len(codes)
    labels = np.arange(n)
    if n < 2:
        return labels
    # levels[0] are the groups of codes, the last level is one group
    levels = [_groups(codes, np.zeros(n, dtype=np.uint64))]
    while len(levels[-1][0]) > 1:
        levels.append(_groups(*levels[-1]))
    a = b = np.zeros(1, dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        lower = levels[level - 1] if level else (codes, np.zeros(n, dtype=np.uint64))
        span = GROUP ** level
        kept_a, kept_b = [], []
        for at in range(0, len(a), 2048):
            a2, b2 = _children(a[at:at + 2048], b[at:at + 2048], len(lower[0]))
            shared = ~(lower[1][a2] | lower[1][b2])
            least = np.bitwise_count((lower[0][a2] ^ lower[0][b2]) & shared)
            near = least <= bits
            a2, b2, least, shared = a2[near], b2[near], least[near], shared[near]
            sure = least + np.bitwise_count(~shared) <= bits  # even if all other bits differ
            for x, y in zip(a2[sure].tolist(), b2[sure].tolist()) if span > 1 else ():
                members = np.r_[x * span:min(n, (x + 1) * span), y * span:min(n, (y + 1) * span)]
                _merge(labels, members[:-1], members[1:])
            if span == 1:
                _merge(labels, a2, b2)
            else:
                kept_a.append(a2[~sure])
                kept_b.append(b2[~sure])
        if level:
            a, b = np.concatenate(kept_a), np.concatenate(kept_b)
    return labels


def _groups(codes: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of GROUP: first code, and the bits on which the members differ or are free already."""
    starts = np.arange(0, len(codes), GROUP)
    first = codes[starts]
    differ = (codes ^ np.repeat(first, GROUP)[:len(codes)]) | free
    return first, np.bitwise_or.reduceat(differ, starts)


def _children(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs x <= y of children of the pairs (a, b) of groups."""
    offset = np.arange(GROUP)
    x = (a[:, None, None] * GROUP + offset[None, :, None]) + 0 * offset[None, None, :]
    y = (b[:, None, None] * GROUP + offset[None, None, :]) + 0 * offset[None, :, None]
    fine = (x < n) & (y < n) & (x <= y)
    return x[fine], y[fine]


def node_links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b with a > b: links that hold the fingerprints of a component together, from each upper node."""
    key = ["_m", "_p", "_m2", "_p2"]
    spread = (nodes.repartition(shuffle_partitions(nodes.sparkSession), *key)
              .sortWithinPartitions(*key, gray_rank(F.col("_fp"))).select(*key, "_fp"))

    def found(codes: np.ndarray):
        labels = links(codes.view(np.uint64), bits)
        apart = np.flatnonzero(labels != np.arange(len(labels)))
        x, y = codes[apart], codes[labels[apart]]
        return np.maximum(x, y), np.minimum(x, y)

    def run(batches):
        held, held_key = [], None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            change = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            out = []
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                at = tuple(c[i] for c in columns[:4])
                if at != held_key and held:
                    out.append(found(np.concatenate(held)))
                    held = []
                held_key = at
                held.append(columns[4][i:j])
            yield as_batch(out)
        if held:
            yield as_batch([found(np.concatenate(held))])

    def as_batch(out):
        a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, dtype=np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return spread.mapInArrow(tidy(run), "a long, b long")


def code_components(codes: DataFrame, bits: int = BITS) -> DataFrame:
    """_fp, _root: for each of the distinct codes that links to another, the least code of its component."""
    stars = components(node_links(below_nodes(codes, bits), bits).distinct())
    return stars.select(F.col("a").alias("_fp"), F.col("b").alias("_root")).unionByName(
        stars.select(F.col("b").alias("_fp"), F.col("b").alias("_root")).distinct())


def grouped(marked: DataFrame, bits: int = BITS) -> DataFrame:
    """``marked`` (staged, with doc_id and _fp) with component_id: the least doc_id that links reach."""
    codes = staged(marked.groupBy("_fp").agg(F.min("doc_id").alias("_first")), "codes")
    linked = code_components(codes, bits).join(codes, "_fp")
    least = linked.groupBy("_root").agg(F.min("_first").alias("_least"))
    named = linked.join(least, "_root").select("_fp", "_least")
    ids = codes.join(named, "_fp", "left").select("_fp", F.coalesce("_least", "_first").alias("component_id"))
    # staged, so that both sides of the join are plain exchanges and Spark can split one fingerprint of many documents
    return marked.drop("component_id").join(staged(ids, "components"), "_fp")


def as_hex(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def document_groups(docs: DataFrame) -> DataFrame:
    marked = staged(with_fingerprints(docs.select("doc_id", "text"), keep_text=False), "fingerprints")
    return grouped(marked).select("doc_id", as_hex(F.col("_fp")).alias("fingerprint"), "component_id")
