import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm import alignment
from seriesloom.llm.bpe import BYTE_BPE, byte_alphabet

A, B = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(alignment.PIECE_BPE)


@pytest.fixture(scope="module")
def library():
    a, b, alphabet = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True

    def tokens(text):
        """(id, bytes) of the whole text by A and B, each in one call."""
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        one = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in ids]
        two = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            two.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == raw == b"".join(x for _, x in two) else ([], [])

    return tokens


def groups_of(one, two):
    ends = [{end: k for k, end in enumerate(np.cumsum([len(x) for _, x in t]).tolist())} for t in (one, two)]
    common = sorted(set(ends[0]) & set(ends[1]))
    out, links, i, j = [], [], 0, 0
    for end in common:
        x, y = ends[0][end] + 1, ends[1][end] + 1
        out.append(",".join(str(k) for k, _ in one[i:x]) + "|" + ",".join(str(k) for k, _ in two[j:y]))
        links.append((one[x - 1][0], two[y - 1][0]))
        i, j = x, y
    return ";".join(out), links


def brute(rows, tokens):
    """Results of (doc_id, text), straight from the rules."""
    found, counts = [], Counter()
    for doc_id, text in rows:
        one, two = tokens(text)
        groups, links = groups_of(one, two)
        counts.update(links)
        found.append((doc_id, len(one), len(two), links, groups))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted((d, a, b, len(links), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
                   hashlib.sha256(groups.encode()).hexdigest() if a else "") for d, a, b, links, groups in found)


def test_stretches_equal_whole_texts(library):
    rnd = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "中文", "the", "Thing's", "12", "--", "▁", "　", "<|endoftext|>", "<s>",
             "\x00", "​", "İ", "ﬁ", "é", "\U0001F600", "<0x41>", "'S", "\r\n"]
    words = alignment.Aligner(A, B)
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 30))) for some in (parts, parts[:14], parts[11:14] + [" "]) for _ in range(300)]
    texts += ["", " ", "   ", "x", "x ", " x", "x  y", "x \n y", "x\n y", "x\n  y", "word " * 300, "y" * 3000]
    for some in (texts, texts[::-1]):  # the second time from memory
        for text, got in zip(some, words.align(some)):
            one, two = library(text)
            groups, links = groups_of(one, two)
            if got is None:
                assert not one, text
            else:
                codes = [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in np.frombuffer(got[3], dtype=np.uint64)]
                assert (got[0], got[1], got[2], codes) == (len(one), len(two), groups, links), text


def test_planes_hold_every_count():
    rnd = np.random.default_rng(2)
    for n_docs, n_pairs, most in ((1, 1, 1), (20, 5, 40), (700, 3, 300), (3, 50, 2)):
        docs = [rnd.integers(0, n_pairs, rnd.integers(0, most)).astype(np.uint64) + np.uint64(7 << 32) for _ in range(n_docs)]
        pairs, n, links, planes = alignment.postings([d.tobytes() for d in docs])
        want = Counter((int(p), i) for i, d in enumerate(docs) for p in d)
        assert dict(zip(pairs.tolist(), links.tolist())) == Counter(p for (p, _), t in want.items() for _ in range(t))
        assert dict(zip(pairs.tolist(), n.tolist())) == Counter(p for p, _ in want)
        for some in (planes, pa.concat_arrays([planes.slice(1), planes.slice(0, 1)]) if len(pairs) else planes):
            row, doc, weight = alignment.opened(some)
            names = pairs if some is planes else np.roll(pairs, -1)
            got = Counter()
            for r, d, w in zip(row.tolist(), doc.tolist(), weight.tolist()):
                got[int(names[r]), d] += w
            assert got == want
        if len(pairs) > 2:
            row, doc, weight = alignment.opened(planes.slice(1, 1))
            assert sum(weight.tolist()) == links[1] and len(set(doc.tolist())) == n[1]


@pytest.mark.parametrize("size", [8 << 20, 2000])
def test_documents_equal_brute_force(odd_docs, no_docs, library, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE", size)
    extra = odd_docs.withColumn("slice", F.lit("x")).withColumn("pair", F.lit(1)).withColumn("doc", F.lit(2.5))
    got = sorted(map(tuple, alignment.aligned_documents(extra).collect()), key=str)
    want = brute([(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()], library)
    assert got == sorted(((None if r[0] == -1 else r[0], *r[1:]) for r in want), key=str)
    assert alignment.aligned_documents(no_docs).count() == 0


def test_pair_counts_and_groups(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = alignment.index(docs, texts=True)
    counts, documents = Counter(), Counter()
    groups = {r["doc_id"]: r["groups"] for r in found.where("pair is null").collect()}
    for r in docs.collect():
        text, links = groups_of(*library(r["text"]))
        assert groups[r["doc_id"]] == text
        counts.update(links)
        documents.update(set(links))
    rows = alignment.pair_counts(found).collect()
    assert {(r["a"], r["b"]): (r["docs"], r["links"]) for r in rows} == {p: (documents[p], n) for p, n in counts.items()}
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    assert all(r["best"] == (r["links"] == highest[r["b"]]) for r in rows)
