"""Token ids in binary files: bit-plane shuffled blocks, compressed plane by plane, with a chunk index.

A file holds the ids of documents in ascending order of their ids:

    MAGIC | chunk ... chunk | index | length of index (8 bytes) | MAGIC

A chunk is a block of up to BLOCK ids. Its planes (bit k, or byte k, of every id) are compressed by zstandard one
by one; planes above the largest id of a block are not stored. The index, itself compressed, holds for each chunk
the offset in the file, the number of ids and the lengths of the planes, and for each document its doc_id and number
of ids, so that a reader can seek to any document. Numbers are little-endian.

Files are written below the shared folder under names of their own for each attempt of a task; the manifest, which
Spark commits, names those that count. A lost executor therefore leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seriesloom.llm.bpe import byte_alphabet
from seriesloom.llm.common import new_folder, pieces, shuffle_partitions, staged

WORD_BPE = "word_bpe_49k.json"
END = 2
MAGIC = b"PLANES01"
BLOCK = 1 << 16
LEVEL = 1
#: Distinct words that a worker remembers in two generations of half as many; longer ones than LONG are encoded each time.
REMEMBERED, LONG = 400_000, 200
#: Bytes of text that are encoded together: a word is looked up once in each.
PIECE = 2 << 20


# White space, letters and digits of Latin-1 as the vocabulary's own splitter takes them, lower case.
_L, _N = "a-zªµº\xdf-\xf6\xf8-\xff", "0-9²³¹¼-¾"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_N}{_L}]+")


class WordEncoder:
    """The tokenizers library over a vocabulary that drops white space.

    Latin-1 texts are lower-cased and cut as the vocabulary's normalizer and splitter do, and the library's model
    encodes each new word once; other texts, and those that may hold added tokens, go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        stand_in = {b: c for c, b in byte_alphabet().items()}
        self.as_bytes = {i: "".join(stand_in[b] for b in chr(i).encode()) for i in range(256)}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > REMEMBERED // 2:  # the young table becomes the old one; what is met again comes back
            self.words, self.older = {}, self.words
        plain = [self.plain(text) for text in texts]
        ids = iter(self.by_words([text for text, cut in zip(texts, plain) if cut]))
        return [next(ids) if cut else self.whole(text) for text, cut in zip(texts, plain)]

    def by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are cut at white space; each distinct word is looked up once."""
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, type=pa.large_string())))
        coded = split.values.dictionary_encode()
        known, older, found, long = self.words, self.older, [], []
        for word in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            if (ids := known.get(word)) is None:
                if (ids := older.get(word)) is None:
                    ids = self.word(word)
                known[word] = ids
                if len(word) > LONG:
                    long.append(word)
            found.append(ids)
        for word in long:
            del known[word]
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.concatenate([[0], n.cumsum()])
        raw = flat[np.arange(ends[-1]) + np.repeat((sizes.cumsum() - sizes)[codes] - ends[:-1], n)].tobytes()
        at = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def word(self, word: str) -> bytes:
        """Ids of a new word; parts of a word are words themselves, so that "end." finds "end"."""
        if word.isalpha() or len(parts := _PARTS.findall(word)) == 1:
            return self.part(word)
        ids = []
        for part in parts:
            if (found := self.words.get(part) or self.older.get(part)) is None:
                found = self.part(part)
                if len(part) <= LONG:
                    self.words[part] = found
            ids.append(found)
        return b"".join(ids)

    def part(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part.translate(self.as_bytes))]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def plain(text: str) -> bool:
        """Whether a text is Latin-1 and may be cut at white space; the library has to see others whole."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(docs: DataFrame, path: str | None = None, end: int | None = END) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, as binary) of each text, ``end`` appended; null: empty text."""
    path = path or public_tokenizers.path(WORD_BPE)
    tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                ids = word_encoder(path).encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x + tail for x in ids], type=pa.binary())],
                                                 names=["doc_id", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def pack_block(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of a block of uint32 ids, lowest first, compressed."""
    if not len(ids):
        return []
    width = max(1, int(ids.max()).bit_length())
    if bits:
        cells = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        planes = [np.packbits(cells[:, k], bitorder="little") for k in range(width)]
    else:
        cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        planes = [cells[:, k] for k in range((width + 7) // 8)]
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    return [squeeze.compress(p.tobytes()) for p in planes]


def unpack_block(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    opened = [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), dtype=np.uint8) for p in planes]
    if bits:
        cells = np.zeros((n, 32), dtype=np.uint8)
        for k, plane in enumerate(opened):
            cells[:, k] = np.unpackbits(plane, bitorder="little")[:n]
        return np.packbits(cells, axis=1, bitorder="little").reshape(-1).view("<u4")
    cells = np.zeros((n, 4), dtype=np.uint8)
    for k, plane in enumerate(opened):
        cells[:, k] = plane
    return cells.reshape(-1).view("<u4")


class Writer:
    """Appends documents to one file; holds one block in memory."""

    def __init__(self, file, bits: bool):
        self.file, self.bits = file, bits
        self.held: list[bytes] = []
        self.held_n = self.n_tokens = 0
        self.chunks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        file.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.doc_ids.append(doc_id)
        self.lengths.append(n)
        self.n_tokens += n
        self.held.append(ids)
        self.held_n += n
        if self.held_n >= BLOCK:
            flat = np.frombuffer(b"".join(self.held), dtype="<u4")
            whole = len(flat) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self.flush(flat[k:k + BLOCK])
            self.held, self.held_n = [flat[whole:].tobytes()], len(flat) - whole

    def flush(self, ids: np.ndarray) -> None:
        planes = pack_block(ids, self.bits)
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        for plane in planes:
            self.file.write(plane)
            self.at += len(plane)

    def close(self) -> None:
        if self.held_n:
            self.flush(np.frombuffer(b"".join(self.held), dtype="<u4"))
        index = zstandard.compress(json.dumps({"bits": self.bits, "chunks": self.chunks, "doc_ids": self.doc_ids,
                                               "lengths": self.lengths}).encode())
        self.file.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.file.close()


class Reader:
    """Documents of one file, in order or one by its place."""

    def __init__(self, file):
        size, self.file = file.size(), file
        tail = file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a file of token ids, or cut off")
        length = int.from_bytes(tail[:8], "little")
        index = json.loads(zstandard.decompress(file.read_at(length, size - 8 - len(MAGIC) - length)))
        self.bits, self.chunks = index["bits"], index["chunks"]
        self.doc_ids, self.lengths = index["doc_ids"], index["lengths"]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        self.chunk_starts = np.concatenate([[0], np.cumsum([c[1] for c in self.chunks], dtype=np.int64)])

    def chunk(self, k: int) -> np.ndarray:
        at, n, lengths = self.chunks[k]
        raw, planes = self.file.read_at(sum(lengths), at), []
        for length in lengths:
            planes.append(raw[:length])
            raw = raw[length:]
        return unpack_block(planes, n, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from place ``start`` to ``stop`` of the file."""
        first = int(np.searchsorted(self.chunk_starts, start, "right")) - 1
        out, k = [], first
        while k < len(self.chunks) and self.chunk_starts[k] < stop:
            out.append(self.chunk(k)[max(0, start - self.chunk_starts[k]):stop - self.chunk_starts[k]])
            k += 1
        return np.concatenate(out) if out else np.zeros(0, dtype="<u4")

    def __iter__(self):
        """doc_id, place of its first id, ids; each chunk is opened once."""
        held, at, k = np.zeros(0, dtype="<u4"), 0, 0  # held: opened ids from place ``at`` on
        for doc_id, start, n in zip(self.doc_ids, self.starts.tolist(), self.lengths):
            if start - at > BLOCK:
                held, at = held[start - at:], start
            parts = [held]
            while at + sum(map(len, parts)) < start + n:
                parts.append(self.chunk(k))
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, start, held[start - at:start - at + n]


def write(docs: DataFrame, path: str | None = None, end: int | None = END, folder: str | None = None,
          partitions: int | None = None, bits: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them in ascending order of doc_id (null first, equal ids by text).

    Returns the manifest: file, part, n_docs, n_tokens, start (ids in the files before). The documents are put in
    ranges of doc_id before they are encoded; ``partitions`` is the number of files.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    ranged = (docs.select("doc_id", "text")
              .repartitionByRange(partitions or shuffle_partitions(spark), F.col("doc_id").asc_nulls_first())
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))

    def run(batches):
        part, writer, file = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    where, base = pafs.FileSystem.from_uri(folder)
                    where.create_dir(base, recursive=True)
                    file = f"part-{part:06d}-{uuid.uuid4().hex}.tokens"
                    writer = Writer(where.open_output_stream(f"{base}/{file}"), bits)
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{file}", "part": part, "n_docs": len(writer.lengths),
                                               "n_tokens": writer.n_tokens}])

    manifest = staged(encode(ranged, path, end).mapInArrow(run, "file string, part long, n_docs long, n_tokens long"),
                      "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document of the files, from the files."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                where, at = pafs.FileSystem.from_uri(row["file"])
                rows, size = [], 0
                with where.open_input_file(at) as file:
                    for doc_id, start, ids in Reader(file):
                        rows.append((doc_id, row["start"] + start, ids.tobytes()))
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield as_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))],
                                          names=["doc_id", "start", "ids"])

    spread = manifest.select("file", "start").repartition(shuffle_partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(run, schema)


def token_checks(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Written and read back: doc_id, start, n_tokens, crc32 of the ids."""
    return read(write(docs, path)).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                          F.crc32("ids").alias("ids_crc32"))
