import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm import bpe

PATH = public_tokenizers.path(bpe.BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n):
    rnd = random.Random(2)
    parts = ["a", "aa", " ", "  ", "\n", "é", "ß", "中", "文", "١", "²", "\x85", "\x1c", "　", "'s", "'LL", "😀", "é", "İ", "#", "<|endoftext|>",
             "\x00", "ﬁ", "Ⅷ", "thing", "ing", "\xad", "µ"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(n)] + ["a" * 3000, "", "ab" * 2000]


def test_encode_and_decode_equal_the_library(library):
    v, texts = bpe.Vocabulary(PATH), random_texts(800)
    want = library.encode_batch(texts, add_special_tokens=False)
    got = v.encode(texts)
    assert got == [np.array(e.ids, dtype="<u4").tobytes() for e in want]
    assert [v.decode(x) for x in got] == [library.decode(e.ids, skip_special_tokens=False) for e in want] == texts


def test_decode_of_broken_utf8_equals_the_library(library):
    v, rnd = bpe.vocabulary(PATH), random.Random(3)
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 12))]
        assert v.decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_compatible_pairs_are_those_that_merge_back():
    v, rnd = bpe.vocabulary(PATH), np.random.default_rng(4)
    tokens = np.array(sorted(v.proposable.values()))
    x, y = rnd.choice(tokens, 4000), rnd.choice(tokens[:2000], 4000)
    want = [v.merged(v.token[a] + v.token[b]) == [a, b] for a, b in zip(x, y)]
    assert v.compatible(x, y).tolist() == want and 0 < sum(want) < 4000


def test_both_ways_of_merging_agree():
    v, rnd = bpe.vocabulary(PATH), random.Random(6)
    for _ in range(300):
        word = bytes(rnd.choice(b"abcehilnorst ") for _ in range(rnd.randint(1, 60)))
        assert v.merged(word) == v.merged_long([v.byte_id[b] for b in word])


def test_odd_rows(odd_docs, library):
    rows = bpe.token_digests(odd_docs).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) == odd_docs.where("doc_id is not null").count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_empty_table_and_clashing_columns(odd_docs, no_docs):
    assert bpe.token_digests(no_docs).count() == 0
    clash = odd_docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    got = bpe.decode(bpe.encode(clash))
    assert sorted(got.columns) == sorted(["doc_id", "lang", "source", "n_chars", "ids", "decoded"])
    assert got.where("doc_id = 4").first()["decoded"] == "one two"
