"""Approximate nearest neighbours by cosine: vantage-point trees, one for each shard of the vectors.

A shard is a run of up to SHARD vectors of an input split, so building the index moves nothing. Equal vectors of a shard
are one point of its tree with the smallest ids (one more than are asked for): copies without number make neither a
tree nor an answer longer. Distances are chords between unit vectors, a metric whose order is that of the cosine.

A tree node splits its points at the median distance from a vantage point and knows the range of distances on either
side. A query's distance to the vantage point then bounds its distance to either side from below (triangle
inequality). A search first visits the leaf of least bound; every other leaf is skipped if its bound times FACTOR
exceeds the distance of the k-th best point so far. FACTOR 1 is exact search; more skips more and may miss some.

Queries go to the shards in blocks; each shard hands on its k best, which are merged by query. Scores are computed from
the original vectors in double precision, always by the same sums, so equal vectors have equal scores.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id; vectors of
another length than a query's are no candidates. A row that is there twice counts once. Ties go to the smaller id.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.llm.common import shuffle_partitions, staged
from seriesloom.llm.exchange import rows_of

SHARD, LEAF, BLOCK = 16_384, 64, 1024
NEAREST, EVERY, FACTOR = 5, 50, 3.0
_SLACK, _SPARE, _TIE = 1e-6, 3, 1e-12


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rows_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, by the same order of sums for all rows."""
    return np.add.reduce(np.ascontiguousarray(a * b), axis=1)


def in_range(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine, so that squares stay within the range of doubles."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0, keepdims=True))[1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = in_range(a), in_range(b)
    return rows_sum(a, b) / (np.sqrt(rows_sum(a, a)) * np.sqrt(rows_sum(b, b)))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = in_range(vectors)
    return scaled / np.sqrt(rows_sum(scaled, scaled))[:, None]


def build(ids: np.ndarray, vectors: np.ndarray, nearest: int = NEAREST) -> dict:
    """Tree over the distinct vectors of a shard; ids: the smallest ids of each point."""
    points, back = np.unique(vectors + 0.0, axis=0, return_inverse=True)
    order = np.lexsort((ids, back))
    pairs = np.unique(np.stack([back[order], ids[order]], axis=1), axis=0)
    starts = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
    ids = [pairs[a:z, 1][:nearest + 1] for a, z in zip(starts, [*starts[1:], len(pairs)])]
    unit_points = unit(points)
    order = np.random.default_rng(len(points)).permutation(len(points))
    nodes: list[tuple] = []  # vantage point, near child, far child, least and largest distance on either side
    leaves: list[tuple[int, int]] = []

    def grow(a: int, z: int) -> int:
        """Node over order[a:z]: its number, or -1 - number of a leaf."""
        if z - a <= LEAF:
            leaves.append((a, z))
            return -len(leaves)
        vantage = int(order[a])
        distance = chord(unit_points[order[a:z]] @ unit_points[vantage])
        by = np.argsort(distance, kind="stable")
        order[a:z], distance = order[a:z][by], distance[by]
        half = (z - a) // 2
        at = len(nodes)
        nodes.append(())
        bounds = (distance[0], distance[half - 1], distance[half], distance[-1])
        nodes[at] = (vantage, grow(a, a + half), grow(a + half, z), *bounds)
        return at

    root = grow(0, len(points))
    return {"points": points[order], "ids": [ids[i] for i in order], "root": root, "leaves": leaves, "bounds": np.array([n[3:] for n in nodes]),
            "children": [n[1:3] for n in nodes], "vantage": unit_points[[n[0] for n in nodes]]}


def chord(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def search(tree: dict, ids: np.ndarray, queries: np.ndarray, nearest: int = NEAREST, factor: float = FACTOR, spare: int = _SPARE):
    """Query number, id and score of the nearest found for each query; also the share of points that were compared.

    Where all of nearest + spare points tie with the last that counts, there may be more: the query is searched again with more.
    """
    n, points = len(queries), tree["points"]
    q, p = unit(queries), unit(points)
    bound = np.zeros((n, len(tree["leaves"])))
    to_vantage = chord(q @ tree["vantage"].T) if len(tree["vantage"]) else np.zeros((n, 0))
    todo = [(tree["root"], np.zeros(n))]
    while todo:
        at, least = todo.pop()
        if at < 0:
            bound[:, -1 - at] = least
            continue
        d, (a, b, c, e) = to_vantage[:, at], tree["bounds"][at]
        near, far = tree["children"][at]
        todo.append((near, np.maximum(least, np.maximum(a - d, d - b))))
        todo.append((far, np.maximum(least, np.maximum(c - d, d - e))))
    keep = nearest + spare
    best = np.full((n, keep), -np.inf)
    place = np.full((n, keep), -1)
    own = np.array([len(x) == 1 for x in tree["ids"]])
    first = np.array([x[0] for x in tree["ids"]])
    compared = 0

    def visit(leaf: int, rows: np.ndarray) -> None:
        nonlocal compared
        a, z = tree["leaves"][leaf]
        cos = q[rows] @ p[a:z].T
        cos[(first[a:z] == ids[rows][:, None]) & own[a:z]] = -np.inf  # the query itself
        compared += cos.size
        both = np.concatenate([best[rows], cos], axis=1)
        where = np.concatenate([place[rows], np.broadcast_to(np.arange(a, z), cos.shape)], axis=1)
        top = np.argpartition(-both, keep - 1, axis=1)[:, :keep] if both.shape[1] > keep else np.broadcast_to(np.arange(both.shape[1]), both.shape)
        top = top[np.arange(len(rows))[:, None], np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable")]
        best[rows], place[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(where, top, 1)

    start = bound.argmin(axis=1)
    for leaf in np.unique(start).tolist():
        visit(leaf, np.flatnonzero(start == leaf))
    for leaf in np.argsort(bound.mean(axis=0)).tolist():
        reach = chord(np.minimum(1.0, best[:, nearest - 1]))  # infinite where fewer are known
        rows = np.flatnonzero((start != leaf) & (bound[:, leaf] * factor <= reach + _SLACK))
        if len(rows):
            visit(leaf, rows)
    more = np.flatnonzero(np.isfinite(best[:, -1]) & (best[:, -1] >= best[:, nearest - 1] - _TIE)) if keep < len(points) else np.zeros(0, dtype=np.int64)
    place[more] = -1
    number, at = np.nonzero(place >= 0)
    point = place[number, at]
    score = cosine(queries[number], points[point])
    counts = np.array([len(tree["ids"][i]) for i in point], dtype=np.int64)
    found = np.concatenate([tree["ids"][i] for i in point]) if len(point) else np.zeros(0, dtype=np.int64)
    number, score = np.repeat(number, counts), np.repeat(score, counts)
    other = found != ids[number]
    number, found, score = number[other], found[other], score[other]
    by = np.lexsort((found, -score, number))
    number, found, score = number[by], found[by], score[by]
    rank = np.arange(len(number)) - np.searchsorted(number, number)
    number, found, score = number[rank < nearest], found[rank < nearest], score[rank < nearest]
    if len(more):
        again = search(tree, ids[more], queries[more], nearest, factor, 4 * spare)
        compared += again[3] * len(more) * len(points)
        number, found, score = np.r_[number, more[again[0]]], np.r_[found, again[1]], np.r_[score, again[2]]
    return number, found, score, compared / max(1, n * len(points))


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    return batch.column(0).to_numpy(), [np.array(v, dtype=np.float64) for v in batch.column(1).to_pylist()]


def _runs(batches, size: int):
    """Length, ids and vectors, of up to ``size`` rows of one length."""
    held: dict[int, list] = {}
    for batch in batches:
        for i, v in zip(*_vectors(batch)):
            rows = held.setdefault(len(v), [])
            rows.append((i, v))
            if len(rows) == size:
                yield len(v), *_stacked(held.pop(len(v)))
    for length, rows in held.items():
        yield length, *_stacked(rows)


def _stacked(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for i, _ in rows], dtype=np.int64), np.stack([v for _, v in rows])


def index(vectors: DataFrame, shard: int = SHARD, nearest: int = NEAREST) -> DataFrame:
    """shard, length, tree: a tree over every run of up to ``shard`` vectors (vec_id, embedding), all rows."""
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for length, ids, rows in _runs(batches, shard):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([length], type=pa.int32()), pa.array([pickle.dumps(build(ids, rows, nearest))], type=pa.binary())],
                                             names=["shard", "length", "tree"])
            number += 1

    return vectors.select("vec_id", "embedding").mapInArrow(run, "shard long, length int, tree binary")


def neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` found among ``vectors`` for each of ``queries``, itself apart."""
    spark = vectors.sparkSession
    groups = shuffle_partitions(spark)
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    trees = staged(index(good, nearest=nearest), "trees").withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(groups)))
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))

    def block(batches):
        for length, ids, rows in _runs(batches, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([length], type=pa.int32()), pa.array([pickle.dumps((ids, rows))], type=pa.binary())], names=["length", "queries"])

    # every block of queries meets every shard; a group of shards gets each block once
    blocks = (asked.select("vec_id", "embedding").mapInArrow(block, "length int, queries binary")
              .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))))

    def run(batches):
        known, tree = None, None
        for row in rows_of(batches):
            if row["shard"] != known:
                known, tree = row["shard"], pickle.loads(row["tree"])
            ids, rows = pickle.loads(row["queries"])
            number, found, score, _ = search(tree, ids, rows, nearest, factor)
            yield pa.RecordBatch.from_arrays([pa.array(ids[number]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = (trees.join(blocks, ["part", "length"]).select("shard", "tree", "queries")
             .mapInArrow(run, "query_id long, vec_id long, score double").distinct())
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def neighbours_of_some(embeddings: DataFrame, every: int = EVERY) -> DataFrame:
    return neighbours(embeddings, embeddings.where(F.col("vec_id") % every == 0))
