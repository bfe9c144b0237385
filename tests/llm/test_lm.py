import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm import lm


def check(docs, exact_model=True):
    rows = docs.select("doc_id", "text").collect()
    tokens = [(r["text"] or "").encode().lower().split() + [None] for r in rows]
    held = [zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10 == 0 for r in rows]
    c = Counter(t for ts, h in zip(tokens, held) if not h for t in ts)
    pairs = Counter(p for ts, h in zip(tokens, held) if not h for p in zip([0, *ts], ts))
    n, v = sum(c.values()), len(c)
    p = {t: (c[t] + 0.1) / (n + 0.1 * (v + 1)) for ts in tokens for t in ts}

    def bigram(a, b):
        seen, context = pairs[a, b], c[None] if a == 0 else c[a]
        return min(1.5 * 2.0 ** math.floor(math.log2(seen)) - 0.5 if seen else 0, context) / max(context, 1)

    want = sorted((str(r["doc_id"]), h, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10(p[t]) for t in ts), 6),
                   round(sum(math.log10(0.5 * bigram(a, b) + 0.5 * p[b]) for a, b in zip([0, *ts], ts)), 6)) for r, ts, h in zip(rows, tokens, held))
    got = sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, lm.scored(docs).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9, atol=1e-5)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-6, atol=1e-4)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert lm.scored(no_docs).count() == 0


def test_only_held_out_texts(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    check(spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string"))


def test_filter_never_loses_a_level_and_seldom_raises_one():
    rnd = np.random.default_rng(1)
    keys, levels = rnd.integers(0, 1 << 56, 60_000, dtype=np.uint64), rnd.integers(1, 6, 60_000)
    part = lm.Filter(int(levels.sum()))
    bits = part.build(keys, levels)
    assert 0.45 < np.unpackbits(bits).mean() < 0.55  # its size follows what it holds
    got = part.levels(bits, keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    assert (part.levels(bits, rnd.integers(0, 1 << 56, 60_000, dtype=np.uint64)) > 0).mean() < 0.05
    assert lm.Filter(0).levels(lm.Filter(0).build(keys[:0], levels[:0]), keys).max() == 0


def test_levels_and_their_middle():
    counts = np.array([0, 1, 2, 3, 4, 7, 8, 1 << 50])
    assert lm.quantised(counts).tolist() == [0, 1, 2, 2, 3, 3, 4, lm.LEVELS]
    assert lm.middle(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]


def test_texts_that_occur_twice_score_apart(spark):
    """A bigram seen once in training counts: a held-out text with a copy among the training texts scores higher than one without."""
    rnd = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rnd.choice(words, 60)) for _ in range(300)]
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, texts[k] if k < 20 else " ".join(rnd.choice(words, 60))) for k, i in enumerate(held)]
    train = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10][:300]
    rows += list(zip(train, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("body", F.lit(1))
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in lm.scored(docs).where("held_out").collect()}
    assert min(got[i] for i in held[:20]) > max(got[i] for i in held[20:])
