import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import vptree


def brute(ids, x, query, k):
    at = np.flatnonzero(ids == query)[0]
    cos = vptree.cosine(np.broadcast_to(x[at], x.shape), x)
    other = np.flatnonzero(ids != query)
    return [(int(ids[i]), float(cos[i])) for i in other[np.lexsort((ids[other], -cos[other]))][:k]]


def data(n=3000, d=16):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(n, d))
    x[: n // 3] = x[0]  # one vector is a third of all
    x[n // 3: n // 2] = x[n // 3] + 0.01 * rnd.normal(size=(n // 2 - n // 3, d))
    order = rnd.permutation(n)
    return order.astype(np.int64), x


@pytest.mark.parametrize("factor", [1.0, 3.0])
def test_search(factor):
    ids, x = data()
    tree = vptree.build(ids, x)
    asked = np.flatnonzero(ids % 25 == 0)
    number, found, score, share = vptree.search(tree, ids[asked], x[asked], 5, factor)
    assert share < 1
    hits = 0
    for k, i in enumerate(asked):
        want, got = brute(ids, x, ids[i], 5), list(zip(found[number == k].tolist(), score[number == k].tolist()))
        assert got == sorted(got, key=lambda r: (-r[1], r[0]))
        hits += len({a for a, _ in want} & {a for a, _ in got})
        if factor == 1:
            assert got == want
    assert hits >= 0.9 * 5 * len(asked)


def test_rows_that_take_no_part_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]),
            (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (100, None), (9, [-0.0, 5.0]), (150, [2.0 ** -700, 2.0 ** -700])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(9))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in vptree.neighbours_of_some(vectors).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 150), (0, 5, 9)]
    assert {g[0] for g in got} == {0, 50, 150} and all(g[2] in (0, 1, 2, 9, 50, 150) for g in got)
    assert vptree.neighbours_of_some(vectors.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got, hits = vptree.neighbours_of_some(table).collect(), 0
    for q in ids[ids % 50 == 0]:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5]
        hits += len({r[1] for r in mine} & {i for i, _ in brute(ids, x, q, 5)})
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_scaled_copies_tie_by_id():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-3, 4, size=(300, 8)).astype(np.float64)
    x[:, 0] = 5
    x[:200] = x[0] * 2.0 ** rnd.permutation(np.arange(-100, 100))[:, None]  # one direction, scores equal to the last bit
    ids = rnd.permutation(300).astype(np.int64)
    number, found, score, _ = vptree.search(vptree.build(ids, x), ids[:3], x[:3], 5, 1.0)
    for k in range(3):
        assert list(zip(found[number == k].tolist(), score[number == k].tolist())) == brute(ids, x, ids[k], 5)
