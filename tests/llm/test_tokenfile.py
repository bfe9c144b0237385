import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriesloom.llm import tokenfile as tf

PATH = public_tokenizers.path(tf.WORD_BPE)


@pytest.mark.parametrize("bits", [False, True])
def test_blocks_round_trip(bits):
    rnd = np.random.default_rng(1)
    for n, top in ((1, 1), (7, 3), (1000, 49408), (5, 1 << 32), (65536, 300)):
        ids = rnd.integers(0, top, n).astype("<u4")
        planes = tf.pack_block(ids, bits)
        assert len(planes) <= (max(1, int(ids.max()).bit_length()) + (0 if bits else 7)) // (1 if bits else 8)
        assert (tf.unpack_block(planes, n, bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_files_round_trip_and_seek(tmp_path, bits):
    rnd, where = np.random.default_rng(2), pafs.LocalFileSystem()
    docs = [(i if i else None, rnd.integers(0, 49408, n).astype("<u4").tobytes()) for i, n in enumerate([0, 5, 70_000, 1, 0, 200_000, 3])]
    writer = tf.Writer(where.open_output_stream(str(tmp_path / "x")), bits)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    with where.open_input_file(str(tmp_path / "x")) as file:
        reader = tf.Reader(file)
        assert [(d, ids.tobytes()) for d, _, ids in reader] == docs
        whole = np.frombuffer(b"".join(ids for _, ids in docs), dtype="<u4")
        for a, b in ((0, 10), (65_530, 65_540), (69_000, 270_000), (270_008, 270_009), (5, 5)):
            assert (reader.ids(a, b) == whole[a:b]).all()
    with pytest.raises(ValueError):
        (tmp_path / "cut").write_bytes((tmp_path / "x").read_bytes()[:-9])
        with where.open_input_file(str(tmp_path / "cut")) as file:
            tf.Reader(file)


def test_words_equal_the_library():
    library, encoder, rnd = Tokenizer.from_file(PATH), tf.WordEncoder(PATH), random.Random(1)
    parts = ["a", "aa", " ", "\n", "é", "ß", "µ", "²", "\xa0", "\xad", "÷", "\x85", "'s", "'T", "É", "#", "!", "12", "\x7f", "thing", "«", "中", "Σ", "\x1c", "<|endoftext|>", "é"]
    for some in (parts[:21], parts):
        texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 40))) for _ in range(700)]
        assert encoder.encode(texts) == [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_word_is_looked_up_once_however_often_it_occurs():
    library, encoder, looked = Tokenizer.from_file(PATH), tf.WordEncoder(PATH), []

    class Counted(dict):
        def get(self, key, *rest):
            looked.append(key)
            return super().get(key, *rest)

        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

        def __contains__(self, key):
            looked.append(key)
            return super().__contains__(key)

    encoder.words = Counted()
    texts = [" ".join(["some", "Words", "again", "été"] * 500), "", " \n", "again"] * 5 + ["中 some"]
    assert encoder.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert len(looked) <= 20
    assert encoder.encode([]) == []


def test_words_are_forgotten_in_two_generations(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 40)
    monkeypatch.setattr(tf, "LONG", 12)
    library, encoder, rnd = Tokenizer.from_file(PATH), tf.WordEncoder(PATH), random.Random(2)
    words = ["end", "end.", "end.end", "a'sb", "12", "…", "x" * 30] + ["".join(rnd.choice("abc.'s1") for _ in range(rnd.randint(1, 14))) for _ in range(300)]
    for _ in range(60):
        texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) + " often" for _ in range(5)]
        assert encoder.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert "often" in encoder.words and not any(len(w) > 12 for w in encoder.words)
        assert len(encoder.words) + len(encoder.older) < 40 + 2 * 150


def test_odd_rows_are_read_back_in_order(odd_docs, no_docs):
    library = Tokenizer.from_file(PATH)
    rows = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want, start = [], 0
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [tf.END]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tf.token_checks(odd_docs).collect()), key=lambda r: r[1]) == want
    assert tf.token_checks(no_docs).count() == 0
