import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm import exchange, spans


def plain(rows):
    """doc_id, bytes -> mask of removed bytes, by a dictionary of all 50-byte strings."""
    last = 1 << 63
    least = {}
    for d, raw in rows:
        for i in range(len(raw) - 49):
            key = raw[i:i + 50]
            least[key] = min(least.get(key, last), last if d is None else d)
    out = []
    for d, raw in rows:
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 49):
            if least[raw[i:i + 50]] < (last if d is None else d):
                gone[i:i + 50] = True
        out.append(gone)
    return out


def check(docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    want = sorted((d if d is not None else -1, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()),
                   hashlib.sha256(np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()).hexdigest()) for (d, raw), gone in zip(rows, plain(rows)))
    got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, spans.removal_digests(docs).collect()))
    assert got == want
    return got


def test_odd_rows(odd_docs, no_docs):
    assert any(r[2] for r in check(odd_docs))
    assert spans.removal_digests(no_docs).count() == 0


def test_repetitive_texts_over_many_chunks(spark):
    rnd = random.Random(8)
    passages = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(40, 130))) for _ in range(12)] + ["a" * 80, "ab" * 40, "é" * 45]
    rows = []
    for i in range(150):
        text = "".join(rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefg ") for _ in range(30)) for _ in range(rnd.randint(0, 6)))
        rows.append((rnd.randrange(140), text))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))


def test_hash_of_substrings_depends_on_content_only():
    raw = bytes(np.random.default_rng(1).integers(0, 4, 5000, dtype=np.uint8))
    rolling, seen = spans.Rolling(raw), {}
    for i, h in enumerate(rolling.all(7).tolist()):
        assert seen.setdefault(raw[i:i + 7], h) == h
    assert len(set(seen.values())) == len(seen)


def test_every_string_is_in_one_phrase():
    raw, sizes = b"xyz" * 40 + b"q" * 49 + b"hello world " * 20, np.array([120, 49, 0, 240])
    parse = spans.Parse(raw, sizes)
    starts = np.concatenate([np.arange(s, s + n) for s, n in zip(parse.start, parse.count)])
    assert sorted(starts.tolist()) == [*range(0, 71), *range(169, 169 + 191)]


def test_characters_stay_whole(spark):
    docs = spark.createDataFrame([(1, "x" + "é" * 40), (2, "y" + "è" * 3 + "é" * 40)], "doc_id long, text string")
    for r in spans.without_repeats(docs, characters=True).collect():
        assert "�" not in bytes(r["kept"]).decode(errors="replace")


def test_clashing_columns_and_lists():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 1000, dtype=np.uint64))
    cut = exchange.ranges(keys, 7)
    assert [b for b, _, _ in cut] == sorted({b for b, _, _ in cut}) and sum(z - a for _, a, z in cut) == 1000
    a, b = exchange.unpack_columns(exchange.pack_columns((keys, 8), (keys & np.uint64(255), 1)), 8, 1)
    assert (a == keys).all() and (b == keys & np.uint64(255)).all()


def test_other_columns_are_kept(odd_docs):
    got = spans.without_repeats(odd_docs.withColumn("spans", F.lit(1)).withColumn("chunk", F.lit("c")))
    assert {"lang", "source", "n_chars", "chunk", "spans", "kept"} <= set(got.columns)
    assert got.where("chunk = 'c'").count() == odd_docs.count()
