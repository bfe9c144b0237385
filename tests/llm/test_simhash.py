import numpy as np
import re
import xxhash
from pyspark.sql import functions as F

from seriesloom.llm import neardup, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(codes, bits):
    labels = np.arange(len(codes))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits
    while True:
        new = np.where(near, labels[None, :], len(codes)).min(axis=1)
        if (new == labels).all():
            return labels
        labels = new[new]


def clustered(seed, n):
    """Distinct codes: dense balls, chains and strangers."""
    rnd = np.random.default_rng(seed)
    out = set()
    for _ in range(n):
        code = int(rnd.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(int(rnd.integers(1, 40))):
            out.add(code)
            for bit in rnd.integers(0, 64, int(rnd.integers(0, 6))):
                code ^= 1 << int(bit)
    return np.array(sorted(out), dtype=np.uint64)


def gray_sorted(codes):
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return codes[np.argsort(rank)]


def test_index_finds_all_components():
    for seed, n, bits in ((1, 60, 4), (2, 5, 4), (3, 40, 6), (4, 1, 0)):
        codes = gray_sorted(clustered(seed, n))
        assert (simhash.links(codes, bits) == components(codes, bits)).all()
    ball = gray_sorted(np.array([(1 << a) | (1 << b) for a in range(64) for b in range(a)], dtype=np.uint64))
    assert (simhash.links(ball, 4) == 0).all()


def test_spark_components_with_split_nodes(spark):
    codes = clustered(9, 50)
    signed = codes.view(np.int64).tolist()
    df = spark.createDataFrame([(c,) for c in signed], "_fp long")
    want = components(codes, 4)
    for split in (50_000, 10):
        stars = simhash.components(simhash.node_links(simhash.below_nodes(df, 4, split)).distinct())
        root = {r["a"]: r["b"] for r in stars.collect()}
        got = [root.get(c, c) for c in signed]
        assert len({(g, int(w)) for g, w in zip(got, want)}) == len(set(got)) == len(set(want.tolist()))


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    codes = np.array([plain(r["text"] or "") for r in rows], dtype=np.uint64)
    labels, last = components(codes, 4), 1 << 63
    least = {l: min((r["doc_id"] for r, m in zip(rows, labels) if m == l and r["doc_id"] is not None), default=None) for l in labels}
    want = sorted((r["doc_id"] if r["doc_id"] is not None else last, f"{c:016x}", least[l]) for r, c, l in zip(rows, codes.tolist(), labels))
    got = sorted((r[0] if r[0] is not None else last, r[1], r[2]) for r in map(tuple, simhash.document_groups(odd_docs).collect()))
    assert got == want
    assert simhash.document_groups(no_docs).count() == 0


def test_one_of_each_group_of_near_copies_stays(spark, odd_docs, no_docs):
    rnd = np.random.default_rng(3)
    base = [" ".join(rnd.choice(["the", "cat", "sat", "on", "a", "mat", "and", "dog", "ran", "off"], 200)) for _ in range(6)]
    rows = [(10 * k + j, t + (f" tail {j}" if j % 2 else ""), "en", "s", 1) for k, t in enumerate(base) for j in range(8)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema)).withColumn("_ndx", F.lit(0))
    got = neardup.without_near_copies(docs)
    assert got.columns == docs.columns
    rounds = neardup.without_near_copies(docs, few=0)  # components of any size in rounds only
    assert sorted(map(str, rounds.collect())) == sorted(map(str, got.collect()))
    before, after = docs.collect(), got.collect()
    sets = [neardup.shingle_set((r["text"] or "").encode()) for r in after]
    for r in before:  # whoever went has one that stayed
        own = neardup.shingle_set((r["text"] or "").encode())
        assert max(neardup.similarity(own, s) for s in sets) >= 0.8
    assert len([r for r in after if r["source"] == "s"]) == 6
    assert len({str(r) for r in after}) == len(after) < len(before)
    assert neardup.without_near_copies(no_docs).count() == 0
