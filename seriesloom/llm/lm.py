"""Language-model scores from a log-frequency Bloom filter.

Counts of all n-grams come from whole training texts. Unigram counts stay exact and travel back to the chunks of texts
that hold the words. Bigram counts are quantised to powers of two, level 1 + floor(log2(count)), and a bigram
of level q goes into a Bloom filter as the q pairs (bigram, 1) ... (bigram, q). To look one up, its pairs are probed
from level 1 until one is missing; a wrong hit can only raise a level, and needs all HASHES bits of it set by others.

Each range of the hash space owns a part of the filter, with as many bits as keep it half empty with all levels of all its
bigrams, single ones too. A chunk sends each range one list of its unigrams and bigrams with their counts in training
texts, 0 included; the range adds them up, builds its part, probes it for each list and sends back counts and levels. So
a key travels once each way, and what is done is the same at every size. The parts are not broadcast: together they grow with the corpus.

score is the sum of log10(LAMBDA * c(v, w) / c(v) + (1 - LAMBDA) * p(w)), where p(w) is the smoothed unigram
probability and c(v, w) the middle of the stored level, at most c(v).

Null text is empty and has one token, the end. A null doc_id counts as the empty text in crc32 (hence held out).
Repeated rows are texts of their own. Without training texts every count is 0, and N and V are 0. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import exchange as ex
from seriesloom.llm.common import staged, tidy

#: Half empty with so many hashes, one probe in a million hits by chance; a part stays where it is built, so its size costs no traffic.
HASHES, LEVELS = 20, 40
LAMBDA, ADDED, FOLDS = 0.5, 0.1, 10
#: Bytes of a key in a list: its high bits are those of the range, so that keys of a range differ in these.
WIDTH = 7
_END, _START = (xxhash.xxh64_intdigest(x) for x in (b" end", b" start"))  # no words: they hold a space
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


class Tokens:
    """Tokens of a chunk: keys (sorted hashes of its distinct tokens), token (place in keys of each), doc of each."""

    def __init__(self, row: dict):
        body, at = row["body"].lower(), 0
        number: dict[bytes, int] = {b" end": 0}
        flat: list[int] = []
        lengths = []
        for size in row["sizes"]:
            words = body[at:at + size].split()
            flat += [number.setdefault(w, len(number)) for w in words]
            flat.append(0)
            lengths.append(len(words) + 1)
            at += size
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w) for w in number], dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.keys, self.token = hashes[order], place[np.array(flat, dtype=np.int64)]
        self.lengths = np.array(lengths, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.doc_ids = ex.from_ipc(row["rest"]).column("doc_id").to_pylist()
        self.held = np.array([held_out(i) for i in self.doc_ids], dtype=bool)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def bigrams(self) -> np.ndarray:
        """Hash of each token with the one before it, or the start."""
        key = self.keys[self.token]
        before = np.r_[np.uint64(_START), key[:-1]]
        before[self.starts] = np.uint64(_START)
        h = (before ^ (before >> np.uint64(31))) * _A + key
        h = (h ^ (h >> np.uint64(29))) * _B
        return h ^ (h >> np.uint64(32))


def counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is one of ``learn``."""
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which[learn], minlength=len(distinct))


def ask(chunks: DataFrame, n: int) -> DataFrame:
    """For each chunk and range one list: the chunk's unigrams, then its bigrams, with their counts in its training texts."""
    def run(batches):
        for row in ex.rows_of(batches):
            t = Tokens(row)
            learn = ~t.held[t.doc]
            lists: dict[int, list[bytes]] = {}
            unigrams = t.keys, np.bincount(t.token[learn], minlength=len(t.keys))
            for k, (keys, counts) in enumerate((unigrams, counted(t.bigrams(), learn))):
                for b, i, j in ex.ranges(keys, n):
                    lists.setdefault(b, [_NOTHING, _NOTHING])[k] = ex.pack_columns((keys[i:j], WIDTH), (counts[i:j], 4))
            yield ex.entry_batch(row["chunk"], [(b, len(x).to_bytes(4, "little") + x + y) for b, (x, y) in sorted(lists.items())])

    return chunks.select("chunk", "body", "sizes", "rest").mapInArrow(tidy(run), ex.ENTRIES)


_NOTHING = ex.pack_columns((np.zeros(0, dtype=np.uint64), WIDTH), (np.zeros(0, dtype=np.uint64), 4))


def two(entry: bytes) -> tuple[bytes, bytes]:
    n = 4 + int.from_bytes(entry[:4], "little")
    return entry[4:n], entry[n:]


def summed(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys, their counts, which of them each entry has, and the lengths of the lists."""
    (keys, counts), lengths = ex.joined_lists(lists, WIDTH, 4)
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(back, counts.astype(np.float64), len(distinct)).astype(np.int64), back, lengths


class Filter:
    """A part of the filter: bits for ``entries`` pairs of a key and a level, half of them set."""

    def __init__(self, entries: int):
        self.size = max(64, int(np.ceil(entries * HASHES / np.log(2))))

    def places(self, keys: np.ndarray, level: int) -> np.ndarray:
        """HASHES bits for each key at a level."""
        one = (keys ^ (keys >> np.uint64(33))) * (_A + np.uint64(2 * level))
        two = ((keys ^ (keys >> np.uint64(28))) * (_B + np.uint64(2 * level))) | np.uint64(1)
        k = np.arange(HASHES, dtype=np.uint64)
        mixed = (one[:, None] ^ (one[:, None] >> np.uint64(32))) + k * (two[:, None] >> np.uint64(20))
        return ((mixed & np.uint64(0xFFFFFFFF)) * np.uint64(self.size) >> np.uint64(32)).astype(np.int64)

    def build(self, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
        cells = np.zeros(self.size, dtype=bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            cells[self.places(keys[levels >= level], level)] = True
        return np.packbits(cells, bitorder="little")

    def levels(self, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Level of each key, 0 if it is not there, by probing one level after the other."""
        out, at = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        for level in range(1, LEVELS + 1):
            place = self.places(keys[at], level)
            at = at[((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(axis=1)]
            if not len(at):
                break
            out[at] = level
        return out


def quantised(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(LEVELS, 1 + np.floor(np.log2(np.maximum(counts, 1)))), 0).astype(np.int64)


def middle(levels: np.ndarray) -> np.ndarray:
    """Mean of the counts of a level: 1 of the first, 2.5 of the second; 0 of none."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1) - 0.5, 0.0)


def range_answers(table: pa.Table) -> pa.Table:
    """For each list of a range the corpus counts of its unigrams and the levels of its bigrams; chunk -1: (all tokens, distinct tokens)."""
    both = [two(x.as_py()) for x in table.column("entries")]
    _, total, back, lengths = summed([x for x, _ in both])
    counts = ex.per_list(total[back].astype(np.uint64), lengths, 5)
    known = ex.pack_columns((np.array([total.sum(), (total > 0).sum()], dtype=np.uint64), 8))
    keys, total, back, lengths = summed([x for _, x in both])
    level = quantised(total)
    part = Filter(int(level.sum()))
    found = part.levels(part.build(keys[level > 0], level[level > 0]), keys)
    levels = ex.per_list(found[back].astype(np.uint64), lengths, 1)
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"chunk": pa.concat_arrays([*table.column("chunk").chunks, pa.array([-1], type=pa.int64())]),
                     "bucket": pa.array([bucket] * (len(counts) + 1), type=pa.int32()),
                     "counts": pa.array([*counts, known], type=pa.binary()), "levels": pa.array([*levels, None], type=pa.binary())})


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and score (the model's)."""
    chunks = ex.pack(docs.select("doc_id", "text"))
    replies = staged(ask(chunks, ex.n_ranges(chunks)).groupBy("bucket").applyInArrow(
        range_answers, "chunk long, bucket int, counts binary, levels binary"), "answers")
    # one row for each range
    stats = [ex.unpack_columns(r["counts"], 8)[0] for r in replies.where(F.col("chunk") == -1).select("counts").toLocalIterator()]
    n, distinct = (int(sum(int(s[k]) for s in stats)) for k in (0, 1))
    bottom = n + ADDED * (distinct + 1)
    answers = (replies.where(F.col("chunk") >= 0).groupBy("chunk")
               .agg(F.array_sort(F.collect_list(F.struct("bucket", "counts", "levels"))).alias("answers")))

    def run(batches):
        for row in ex.rows_of(batches):
            t = Tokens(row)
            count = np.concatenate([ex.unpack_columns(a["counts"], 5)[0] for a in row["answers"]]).astype(np.float64)
            unigram = (count + ADDED) / bottom
            end = int(np.searchsorted(t.keys, np.uint64(_END)))
            before = np.r_[end, t.token[:-1]]
            before[t.starts] = end  # as many starts as ends
            _, back = np.unique(t.bigrams(), return_inverse=True)
            level = np.concatenate([ex.unpack_columns(a["levels"], 1)[0] for a in row["answers"]]).astype(np.int64)[back]
            context = count[before]
            bigram = np.minimum(middle(level), context) / np.maximum(context, 1.0)
            p = unigram[t.token]
            sums = [np.add.reduceat(x, t.starts) for x in (np.log10(p), np.log10(LAMBDA * bigram + (1 - LAMBDA) * p))]
            known = np.add.reduceat((count[t.token] > 0).astype(np.int64), t.starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.doc_ids, type=pa.int64()), pa.array(t.held), pa.array(t.lengths), pa.array(known), pa.array(np.full(len(t.lengths), n, dtype=np.int64)),
                 pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunks.join(answers, "chunk").drop("chunk").mapInArrow(
        tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
