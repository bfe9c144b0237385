"""BPE encoding and decoding by speculation and verification.

A greedy longest match over the vocabulary proposes the tokens of a word. The proposal equals the result of
the merges exactly when every adjacent pair of it is compatible, that is, when merging the two tokens' bytes
together gives back the two tokens. All adjacent pairs of all new words of a batch are tested at once with
numpy; only words with an incompatible pair go through the merges themselves.

Null text is the empty text and has no ids. Rows are handled one by one: repeated rows give repeated results,
columns besides ``text`` are passed on as they are, an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import pieces, tidy

#: Vocabulary file, and how many distinct words a worker remembers.
BYTE_BPE = "byte_bpe_50k.json"
REMEMBERED = 120_000
#: Words of more bytes are merged with a queue.
SHORT = 64

# The published pattern of this vocabulary, spelled out for the characters of Latin-1.
_L, _N, _S = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9²³¹¼-¾", r" \t-\r\x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_NONE = 1 << 40
_NEVER = np.int64(_NONE)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level vocabulary file and the encoder over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, alphabet = spec["model"], byte_alphabet()
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        as_bytes = {t: bytes(alphabet[c] for c in t) for t in model["vocab"]}
        size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token: list[bytes] = [b""] * size
        for t, i in model["vocab"].items():
            self.token[i] = as_bytes[t]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need whole words are not supported")
        for content, i in self.added.items():
            self.token[i] = content.encode()
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = (rank, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = rank, x, y
        keys = np.array([(x << 32) | y for x, y in self.merge], dtype=np.int64)
        ranks = np.array([r for r, _ in self.merge.values()], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], ranks[order]
        self.byte_id = [vocab.get(c) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.proposable = self._proposable(as_bytes, vocab)
        self.walk = {t[:n]: -1 for t in self.proposable for n in range(1, len(t))} | self.proposable
        self.words: dict[str, bytes] = {}
        self._splitter = None
        self.path = path

    def _proposable(self, as_bytes: dict[str, bytes], vocab: dict[str, int]) -> dict[bytes, int]:
        """Tokens that the merges do produce from their own bytes; only these may be proposed."""
        made = np.flatnonzero(self.rank >= 0)
        fine = np.ones(len(self.rank), dtype=bool)
        fine[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:
            fine[i] = fine[i] and fine[self.left[i]] and fine[self.right[i]]
        return {as_bytes[t]: i for t, i in vocab.items() if fine[i] and (self.rank[i] >= 0 or len(as_bytes[t]) == 1)}

    def pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of each pair (x, y), among the merges of rank under ``below``.

        The tokens at the border are unmade in the reverse order of their merges. A pair of tokens that meet at
        the border lasts until the earlier of the two takes part in its next merge; a crossing merge happens if
        its rank is lower than that. Of equal ranks the one further left goes first.
        """
        result = np.ones(len(x), dtype=bool)
        at = np.arange(len(x))
        until = np.full(len(x), _NEVER - 1) if below is None else below.copy()
        x, y = x.copy(), y.copy()
        while len(at):
            crossed = self.pair_ranks(x, y) < until
            result[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            unmake_x = rx > ry
            until = np.where(unmake_x, rx, ry + 1)
            x, y = np.where(unmake_x, self.right[x], x), np.where(unmake_x, y, self.left[y])
        return result

    def propose(self, word: bytes) -> list[int]:
        known = self.proposable
        if (token := known.get(word)) is not None:
            return [token]
        out, start, n, walk = [], 0, len(word), self.walk
        while start < n:
            end = start + 1
            while (step := walk.get(word[start:end])) is not None:  # tokens and beginnings of tokens
                if step >= 0:
                    token, stop = step, end
                if end == n:
                    break
                end += 1
            out.append(token)
            start = stop
        return out

    def merged(self, word: bytes) -> list[int]:
        """The merges themselves: lowest rank first, of equal ranks the leftmost."""
        ids: list[int] = [self.byte_id[b] for b in word]
        if len(ids) > SHORT:
            return self.merged_long(ids)
        merge, none = self.merge, (_NONE, -1)
        nexts = [merge.get(pair, none) for pair in zip(ids, ids[1:])]
        while nexts and (best := min(nexts))[0] < _NONE:
            i = nexts.index(best)
            ids[i:i + 2] = (best[1],)
            del nexts[i]
            if i < len(nexts):
                nexts[i] = merge.get((best[1], ids[i + 1]), none)
            if i:
                nexts[i - 1] = merge.get((ids[i - 1], best[1]), none)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a queue, n log n in the word's length."""
        after, before = [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)]
        queue = [(m[0], i, m[1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i, z = heapq.heappop(queue)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or self.merge.get((ids[i], ids[j])) != (rank, z):
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if m := self.merge.get((z, ids[k])):
                    heapq.heappush(queue, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], z))):
                heapq.heappush(queue, (m[0], h, m[1]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposed), dtype=np.int64, count=len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, dtype=np.int64)
        # each distinct pair is tested once
        pairs, back = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back] if len(pairs) else np.zeros(0, dtype=bool)
        for i in np.unique(owner[inner[bad]]).tolist():
            proposed[i] = self.merged(raw[i])
        return proposed

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens. Beyond Latin-1 the vocabulary's own splitter finds them."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self._splitter is None:
                from tokenizers import Tokenizer
                self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]
        return _LATIN.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list[str]] = []
        for text in texts:
            parts = self.added_pattern.split(text) if any(a in text for a in self.added) else [text]
            words: list[str] = []
            for k, part in enumerate(parts):
                words += [part] if k % 2 else self.split(part)
            split.append(words)
        if len(self.words) > REMEMBERED:
            self.words = {}
        if not self.words:
            self.words = {a: np.array([i], dtype="<u4").tobytes() for a, i in self.added.items()}
        known = self.words
        new = list({w for words in split for w in words if w not in known})
        for word, ids in zip(new, self.encode_words(new), strict=True):
            known[word] = np.array(ids, dtype="<u4").tobytes()
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode(errors="replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with ``text`` replaced by column ``to``: its ids, little-endian unsigned 32-bit, as binary.

    A column of the name ``to`` that is already there is replaced.
    """
    path = path or public_tokenizers.path(BYTE_BPE)
    docs = docs.select(*[c for c in docs.columns if c not in (text, to)], F.coalesce(text, F.lit("")).alias(to))
    schema = T.StructType([f if f.name != to else T.StructField(to, T.BinaryType()) for f in docs.schema])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, to):
                at = part.schema.get_field_index(to)
                ids = pa.array(vocabulary(path).encode(part.column(at).to_pylist()), type=pa.binary())
                columns = [ids if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(tidy(run), schema)


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ``ids`` added; special tokens are kept, broken UTF-8 becomes U+FFFD."""
    path = path or public_tokenizers.path(BYTE_BPE)
    tokens = tokens.drop(to)
    schema = T.StructType([*tokens.schema, T.StructField(to, T.StringType())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, ids):
                column = part.column(part.schema.get_field_index(ids)).to_pylist()
                texts = pa.array([vocabulary(path).decode(x or b"") for x in column], type=pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, to])

    return tokens.mapInArrow(tidy(run), schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encoded and decoded again: doc_id, n_tokens, SHA-256 of the ids and of the decoded text."""
    both = decode(encode(docs.select("doc_id", "text"), path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
