"""Alignment of two tokenizers over a corpus, by inverted pair bitmaps.

Tokenizer A writes a space and the text, tokenizer B the text (it puts the space itself). Byte offsets where a token of
both ends cut the tokens into groups; the two tokens that end there are linked. For each pair of ids an index holds the
documents that link it as a compressed bitmap, and how often each does as planes: plane k has the documents whose number
of links has bit k set. The bitmap of a pair is the OR of its planes, its population count is the number of documents,
and the sum of 2^k times the counts of the planes is the number of links.

The index is cut into slices of up to SLICE bytes of text, written by the task that reads them, so that a frequent pair costs one
posting a slice; slices hold different documents, hence the counts of a pair's merged bitmap are the sums of those of its
slices. The counts of a pair, and whether they are the highest of its B id, go back along its postings to the slices, where the
planes deal them out to the documents. No task holds more than its slices' documents, and no pair is gathered whole.

Both tokenizers cut wherever a space follows a character that is no white space, so that a stretch between two such places is
encoded and aligned once for each worker's memory; new stretches of a batch are encoded in one call.

Texts that are null, empty or not restored by the tokens' bytes have no tokens: zeros and an empty digest. A null
doc_id stays null; every row is a document of its own, repeated or not. Other columns are ignored. An empty table gives no
rows. Ties for the highest count of a B id are all highest.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.llm.bpe import BYTE_BPE, byte_alphabet
from seriesloom.llm.common import pieces, shuffle_partitions, staged, tidy

PIECE_BPE = "piece_bpe_32k.model"
#: Bytes of text and documents of a slice; a byte of a bitmap is named by 16 bits.
SLICE, SLICE_DOCS = 8 << 20, 1 << 18
#: Stretches that a worker remembers, in two generations; longer ones than LONG characters are encoded each time.
REMEMBERED, LONG = 300_000, 100
#: Place of the byte (two bytes) and the byte itself.
_CELL = 3

_STRETCHES = re.compile(r"(?<=\S)(?= )")
_HEX = re.compile("<0x([0-9A-F]{2})>")
_BITS = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)

#: A, B tokens, the groups as text, the linked pairs as uint64 (A id above, B id below); None: not restored.
Aligned = tuple[int, int, str, bytes] | None


class Aligner:
    """Two tokenizers and the aligned stretches that a worker remembers."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes_b = [self.piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.shown = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)]
        self.known: dict[str, Aligned] = {}
        self.older: dict[str, Aligned] = {}

    @staticmethod
    def piece_bytes(piece: str) -> bytes:
        if hexed := _HEX.fullmatch(piece):
            return bytes([int(hexed[1], 16)])
        return piece.replace("▁", " ").encode()

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``text``, which begins with a space, by A and B; None where their bytes do not restore it."""
        ids_a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids_b = self.b.encode(text[1:]) or [self.b.piece_to_id("▁")]  # an empty text gets no space from B
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            return None
        return np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)

    def aligned(self, stretches: list[str]) -> list[Aligned]:
        """Each stretch aligned; all are encoded at once, in ever smaller parts only where that does not restore them."""
        both = self.encoded("".join(stretches)) if stretches else None
        if both is not None:
            a, b = both
            ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
            common = np.intersect1d(ends_a, ends_b, assume_unique=True)
            last = np.searchsorted(common, ends := np.cumsum([len(s.encode()) for s in stretches]))
        if both is None or (common[last] != ends).any():
            if len(stretches) < 2:
                return [None] * len(stretches)
            half = len(stretches) // 2
            return self.aligned(stretches[:half]) + self.aligned(stretches[half:])
        to_a, to_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
        links = (a[to_a - 1].astype(np.uint64) << np.uint64(32)) | b[to_b - 1].astype(np.uint64)
        # ids as text with what follows them, group by group: A's, the last with a bar, then B's, the last with a semicolon
        ends_group = np.zeros(len(a) + len(b), dtype=np.int64)
        ends_group[to_a - 1] = ends_group[len(a) + to_b - 1] = 1
        group = np.concatenate([2 * (np.cumsum(ends_group[:len(a)]) - ends_group[:len(a)]), 2 * (np.cumsum(ends_group[len(a):]) - ends_group[len(a):]) + 1])
        number = np.concatenate([a, b + 2 * len(self.bytes_a)]) + ends_group * np.repeat([len(self.bytes_a), len(self.bytes_b)], [len(a), len(b)])
        shown = list(map(self.shown.__getitem__, number[np.argsort(group, kind="stable")].tolist()))
        cut_a, cut_b, out, at = [0, *to_a.tolist()], [0, *to_b.tolist()], [], 0
        for to in (last + 1).tolist():
            x, y = cut_a[at] + cut_b[at], cut_a[to] + cut_b[to]
            out.append((cut_a[to] - cut_a[at], cut_b[to] - cut_b[at], "".join(shown[x:y])[:-1], links[at:to].tobytes()))
            at = to
        return out

    def align(self, texts: list[str]) -> list[Aligned]:
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        # U+2581 would come back as a space, so that such texts are never restored
        split = [_STRETCHES.split(" " + text) if text and "▁" not in text else None for text in texts]
        known, older, new = self.known, self.older, []
        for stretch in dict.fromkeys(s for some in split if some for s in some):
            if stretch not in known:
                if stretch in older:
                    known[stretch] = older[stretch]
                else:
                    new.append(stretch)
        # what ends in white space is encoded alone, as its end would meet the next stretch's space
        inner = [s for s in new if not s[-1].isspace()]
        known.update(zip(inner, self.aligned(inner)))
        for stretch in new:
            if stretch[-1].isspace():
                known[stretch] = self.aligned([stretch])[0]
        out: list[Aligned] = []
        for some in split:
            parts = [known[s] for s in some] if some else [None]
            if None in parts:
                out.append(None)
            else:
                a, b, groups, links = zip(*parts)
                out.append((sum(a), sum(b), ";".join(groups), b"".join(links)))
        for stretch in new:
            if len(stretch) > LONG:
                del known[stretch]
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def bitmap_bytes(pair: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the bitmaps of sorted, distinct (pair, doc) that are not zero: pair, place, byte."""
    if not len(pair):
        return pair, doc, np.zeros(0, dtype=np.uint8)
    place = doc >> 3
    starts = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])])
    return pair[starts], place[starts], np.bitwise_or.reduceat(np.left_shift(1, doc & 7).astype(np.uint8), starts)


def postings(links: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The index of a slice from the linked pairs of its documents: pairs, documents and links of each, planes of each."""
    codes = np.frombuffer(b"".join(links), dtype=np.uint64)
    n_docs = max(1, len(links))
    pairs, which = np.unique(codes, return_inverse=True)
    cells, times = np.unique(which * n_docs + np.repeat(np.arange(len(links)), [len(x) // 8 for x in links]), return_counts=True)
    pair, doc = cells // n_docs, cells % n_docs
    merged, _, byte = bitmap_bytes(pair, doc)
    docs = np.bincount(merged, _BITS[byte], len(pairs)).astype(np.int64)
    found = []
    for k in range(int(times.max()).bit_length() if len(times) else 0):
        own = times >> k & 1 == 1
        found.append((*bitmap_bytes(pair[own], doc[own]), k))
    of, place, byte = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
    plane = np.repeat([f[3] for f in found], [len(f[0]) for f in found]).astype(np.int64)
    total = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(total, of, _BITS[byte] << plane)
    # one list of planes for each pair; planes below the highest one may be empty
    order = np.lexsort((place, plane, of))
    of, place, byte, plane = of[order], place[order], byte[order], plane[order]
    highest = np.zeros(len(pairs), dtype=np.int64)
    np.maximum.at(highest, of, plane)
    list_ends = np.concatenate([[0], np.cumsum(highest + 1)])
    sizes = np.bincount(list_ends[of] + plane, minlength=int(list_ends[-1])) if len(pairs) else np.zeros(0, dtype=np.int64)
    body = np.empty((len(of), _CELL), dtype=np.uint8)
    body[:, 0], body[:, 1], body[:, 2] = place & 255, place >> 8, byte
    ends = np.concatenate([[0], np.cumsum(sizes * _CELL)]).astype(np.int32)
    planes = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])
    return pairs, docs, total, pa.ListArray.from_arrays(pa.array(list_ends, type=pa.int32()), planes)


def opened(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and weight (2^plane) of every bit of the planes of each row."""
    flat, offsets = planes.flatten(), planes.offsets.to_numpy()
    row = np.repeat(np.arange(len(planes)), np.diff(offsets))
    plane = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    ends = np.frombuffer(flat.buffers()[1], dtype=np.int32, count=len(flat) + 1, offset=4 * flat.offset) if len(flat) else np.zeros(1, dtype=np.int32)
    data = flat.buffers()[2] if len(flat) and flat.buffers()[2] is not None else pa.py_buffer(b"")
    cells = np.frombuffer(data, dtype=np.uint8, count=int(ends[-1] - ends[0]), offset=int(ends[0])).reshape(-1, _CELL)
    of = np.repeat(np.arange(len(flat)), np.diff(ends) // _CELL)
    at, bit = np.nonzero(np.unpackbits(cells[:, 2:], axis=1, bitorder="little"))
    doc = (cells[at, 0].astype(np.int64) | cells[at, 1].astype(np.int64) << 8) * 8 + bit
    return row[of[at]], doc, np.left_shift(1, plane[of[at]])


INDEX = ("slice long, doc int, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, groups string, "
         "pair long, docs long, links long, planes array<binary>")


def index(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, texts: bool = False) -> DataFrame:
    """Documents (slice, doc, doc_id, counts, digest of the groups; with ``texts`` the groups too) and postings (slice, pair,
    docs, links, planes) of the aligned texts, in one staged table; ``pair`` is null in the rows of documents."""
    path_a, path_b = path_a or public_tokenizers.path(BYTE_BPE), path_b or public_tokenizers.path(PIECE_BPE)
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = dict(zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                             pa.int64(), pa.list_(pa.binary()))))

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], type=t) if c in columns and not isinstance(columns[c], pa.Array)
                                           else columns.get(c, pa.nulls(n, type=t)) for c, t in kinds.items()], names=names)

    def run(batches):
        number, size, links = TaskContext.get().partitionId() << 32, 0, []

        def closed():
            pairs, n_docs, total, planes = postings(links)
            for k in range(0, len(pairs), 20_000):
                own = slice(k, k + 20_000)
                n = len(pairs[own])
                yield batch_of(n, slice=np.full(n, number), pair=pairs[own].view(np.int64), docs=n_docs[own], links=total[own],
                               planes=planes.slice(k, 20_000))

        for batch in batches:
            for part in pieces(batch, "text"):
                found = [(0, 0, "", b"") if x is None else x
                         for x in aligner(path_a, path_b).align(part.column(1).to_pylist())]
                yield batch_of(len(found), slice=[number] * len(found), doc=list(range(len(links), len(links) + len(found))), doc_id=part.column(0),
                               n_a=[x[0] for x in found], n_b=[x[1] for x in found], n_links=[len(x[3]) // 8 for x in found],
                               groups_sha256=[hashlib.sha256(x[2].encode()).hexdigest() if x[0] else "" for x in found],
                               **({"groups": [x[2] for x in found]} if texts else {}))
                links += [x[3] for x in found]
                size += part.column(1).nbytes
                if size > SLICE or len(links) > SLICE_DOCS:
                    yield from closed()
                    number, size, links = number + 1, 0, []
        if links:
            yield from closed()

    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return staged(plain.mapInArrow(tidy(run), INDEX), "alignment-index")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, a, b, docs, links, best (no pair of the same B id has more links) over all slices of an index."""
    counts = found.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    counts = counts.withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    highest = F.max("links").over(Window.partitionBy("b"))  # a B id has at most as many pairs as A has ids
    return counts.withColumn("best", F.col("links") == highest)


def document_scores(found: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of the documents of an index."""
    spark = found.sparkSession
    scores = pair_counts(found).select("pair", F.col("links").alias("count"), "best")
    back = (found.where("pair is not null").select("slice", "pair", "planes").join(scores, "pair").drop("pair")
            .repartition(shuffle_partitions(spark), "slice"))

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            slices, planes, count, best = (batch.column(batch.schema.get_field_index(c)) for c in ("slice", "planes", "count", "best"))
            row, doc, weight = opened(planes)
            own, which = np.unique(slices.to_numpy(), return_inverse=True)
            count, best = count.to_numpy()[row] * weight, best.to_numpy(zero_copy_only=False)[row] * weight
            of = which[row]
            for k, number in enumerate(own.tolist()):
                here = of == k if len(own) > 1 else slice(None)
                most = int(doc[here].max(initial=-1)) + 1
                held = sums.get(number, np.zeros((2, 0), dtype=np.int64))
                if held.shape[1] < most:
                    held = sums[number] = np.pad(held, ((0, 0), (0, max(most, 2 * held.shape[1]) - held.shape[1])))
                np.add.at(held[0], doc[here], count[here])
                np.add.at(held[1], doc[here], best[here])
        for number, held in sums.items():
            some = np.flatnonzero(held[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(some.astype(np.int32)), pa.array(held[0][some]),
                                              pa.array(held[1][some])], names=["slice", "doc", "count_sum", "n_best"])

    dealt = back.mapInArrow(tidy(run), "slice long, doc int, count_sum long, n_best long")
    rows = found.where("pair is null").select("slice", "doc", "doc_id", "n_a", "n_b", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return rows.join(dealt, ["slice", "doc"], "left").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def aligned_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    return document_scores(index(docs, path_a, path_b))
