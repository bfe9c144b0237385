"""Repeated passages of 50 bytes by prefix-free parsing.

A text is parsed into phrases at triggers of a rolling hash: of the 24-byte strings inside a 50-byte string, the one of
least hash is its trigger, and the 50-byte strings that follow one another with the same trigger make one phrase. So
each 50-byte string of a text starts in exactly one phrase, and equal strings have equal triggers wherever they stand.
The dictionary is the set of distinct phrases; the parse is the list of a text's phrases.

What has to be known of the order of all suffixes of the corpus is which agree on 50 bytes, and the least document of
each such run. The dictionary gives it in two steps. Phrases whose trigger belongs to one phrase only, however often it
occurs, are settled by the least document of that phrase: that is the case inside copied text. For the other phrases
their suffixes, cut at 50 bytes, are sorted and equal runs take their least document. Suffixes are sorted by a 64-bit
hash of their 50 bytes instead of by the bytes: equality is all that counts, and hash order spreads evenly over the
cluster, where lexicographic order would put common beginnings into one range. Finally each text combines its parse
with what the dictionary says.

Both steps exchange compressed lists for each chunk of the corpus (see ``exchange``): a phrase costs one entry for each
chunk that holds it, so copies by the million or a passage in a third of all texts collect nowhere.

Null text is empty and keeps nothing; a null doc_id counts as larger than all others; rows of equal doc_id do not
remove from one another. Columns that clash with those added are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import exchange as ex
from seriesloom.llm.common import staged, tidy

LENGTH, TRIGGER = 50, 24
_NO_ID = np.int64(np.iinfo(np.int64).max)
_FLIP = np.uint64(1 << 63)
#: Answers about a trigger: its phrase is one and the same everywhere, and here first or not; or phrases differ.
ONE_FIRST, ONE_LATER, DIFFER, DIFFER_HERE = range(4)
_MIXED = np.uint64(0)
#: Triggers are sent without their 16 low bits; two that fall together only count as one whose phrases differ.
_16 = np.uint64(16)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _M1
    h ^= h >> np.uint64(32)
    h *= _M2
    h ^= h >> np.uint64(29)
    return h


class Rolling:
    """Hash of any substring of ``raw`` from running sums of a polynomial modulo 2**64."""

    base = np.uint64(0x5851F42D4C957F2D)
    inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
    letters = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype=np.uint64)
    powers = np.ones(1, dtype=np.uint64)
    inverses = np.ones(1, dtype=np.uint64)

    def __init__(self, raw: bytes):
        n = len(raw)
        if n >= len(Rolling.powers):
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n + 1, base, dtype=np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.letters[np.frombuffer(raw, dtype=np.uint8)] * self.powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stops] - self.sums[starts]) * self.inverses[starts])

    def all(self, length: int) -> np.ndarray:
        """Hashes of the substrings of a length, from each place."""
        n = max(0, len(self.sums) - length)
        return _mix((self.sums[length:length + n] - self.sums[:n]) * self.inverses[:n])


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    least, step = h, 1
    while 2 * step <= width:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    if step < width:
        n = len(h) - width + 1
        least = np.minimum(least[:n], least[width - step:width - step + n])
    return least


class Parse:
    """Phrases of a chunk: start (place of the first string), count (strings), trigger, doc (number in the chunk)."""

    def __init__(self, body: bytes, sizes: np.ndarray):
        ends = np.cumsum(sizes)
        self.rolling = Rolling(body)
        if len(body) < LENGTH:
            self.start = self.count = self.doc = np.zeros(0, dtype=np.int64)
            self.trigger = np.zeros(0, dtype=np.uint64)
        else:
            trigger = sliding_least(self.rolling.all(TRIGGER), LENGTH - TRIGGER + 1)
            n = len(trigger)
            cut = np.zeros(n + 1, dtype=bool)
            cut[0] = cut[n] = True
            cut[1:n] = trigger[1:] != trigger[:-1]
            # strings that would reach into the next text are runs of their own, and dropped
            first = ends - sizes
            last = np.maximum(first, ends - LENGTH + 1)
            cut[np.minimum(first, n)] = True
            cut[np.minimum(last, n)] = True
            at = np.flatnonzero(cut)
            start, count = at[:-1], np.diff(at)
            doc = np.searchsorted(ends, start, side="right")
            fine = start + LENGTH <= ends[doc]
            self.start, self.count, self.doc = start[fine], count[fine], doc[fine]
            self.trigger = _mix(trigger[start[fine]])  # least hashes lie near 0; mixed again, they fill all ranges evenly
        self.order = np.argsort(self.trigger, kind="stable")
        ordered = self.trigger[self.order]
        self.firsts = ex.group_starts(ordered)
        self.distinct = ordered[self.firsts]
        number = np.zeros(len(ordered), dtype=np.int64)
        number[self.firsts[1:]] = 1
        self.number = np.empty(len(ordered), dtype=np.int64)
        self.number[self.order] = np.cumsum(number)  # of each phrase: place of its trigger in ``distinct``

    def least_doc(self, ids: np.ndarray) -> np.ndarray:
        """Least id among the texts that hold each distinct trigger."""
        return np.minimum.reduceat(ids[self.doc[self.order]], self.firsts) if len(self.firsts) else np.zeros(0, dtype=np.int64)

    def phrase(self) -> np.ndarray:
        """Hash of the phrase of each distinct trigger, 32 bits and not 0; 0 if the chunk has several."""
        if not len(self.firsts):
            return np.zeros(0, dtype=np.uint64)
        code = (self.rolling.of(self.start, self.start + self.count + LENGTH - 1) >> np.uint64(32)) | np.uint64(1)
        code = code[self.order]
        low, high = np.minimum.reduceat(code, self.firsts), np.maximum.reduceat(code, self.firsts)
        return np.where(low == high, low, _MIXED)


def as_key(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers of the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ _FLIP


def chunk_ids(rest: bytes) -> np.ndarray:
    column = ex.from_ipc(rest).column("doc_id")
    return np.array([_NO_ID if x is None else x for x in column.to_pylist()], dtype=np.int64)


def ask_triggers(chunks: DataFrame) -> DataFrame:
    n = ex.n_ranges(chunks)

    def run(batches):
        for row in ex.rows_of(batches):
            parse = Parse(row["body"], np.array(row["sizes"], dtype=np.int64))
            least, phrase = as_key(parse.least_doc(chunk_ids(row["rest"]))), parse.phrase()
            yield ex.entry_batch(row["chunk"], [(b, ex.pack_columns((parse.distinct[i:j] >> _16, 6), (phrase[i:j], 4), (least[i:j], 8)))
                                                for b, i, j in ex.ranges(parse.distinct, n)])

    return chunks.select("chunk", "body", "sizes", "rest").mapInArrow(tidy(run), ex.ENTRIES)


def settle_triggers(lists: list[bytes]) -> list[bytes]:
    (trigger, phrase, least), lengths = ex.joined_lists(lists, 6, 4, 8)
    order = np.argsort(trigger, kind="stable")
    firsts = ex.group_starts(trigger[order])
    sizes = np.diff(np.r_[firsts, len(trigger)])
    p = phrase[order]
    low, high = np.minimum.reduceat(p, firsts), np.maximum.reduceat(p, firsts)
    first = np.repeat(np.minimum.reduceat(least[order], firsts), sizes)
    one = np.repeat((low == high) & (low != _MIXED), sizes)
    alone = np.repeat(sizes == 1, sizes)
    code = np.empty(len(trigger), dtype=np.uint64)
    code[order] = np.where(one, np.where(first < least[order], ONE_LATER, ONE_FIRST), np.where(alone, DIFFER_HERE, DIFFER))
    return ex.per_list(code, lengths)


class Known:
    """What a chunk knows after the answers about its triggers.

    start, stop: runs of bytes to remove; keys, least: the suffixes to ask about, in order, and their least id here;
    place, number: the strings that wait for an answer, and which of the keys they wait for.
    """

    def __init__(self, row: dict):
        ids, parse = chunk_ids(row["rest"]), Parse(row["body"], np.array(row["sizes"], dtype=np.int64))
        code = np.concatenate([ex.unpack_columns(a["answer"], 1)[0] for a in row["answers"]])[parse.number]
        later = ids[parse.doc] > parse.least_doc(ids)[parse.number]
        sure = (code == ONE_LATER) | ((code == ONE_FIRST) & later)
        unsettled = np.flatnonzero(code >= DIFFER)
        counts = parse.count[unsettled]
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        place = np.repeat(parse.start[unsettled], counts) + inner
        shared = np.repeat(code[unsettled] == DIFFER, counts)
        doc = ids[np.repeat(parse.doc[unsettled], counts)]
        suffix = parse.rolling.of(place, place + LENGTH)
        order = np.argsort(suffix, kind="stable")
        suffix, place, shared, doc = suffix[order], place[order], shared[order], doc[order]
        firsts = ex.group_starts(suffix)
        sizes = np.diff(np.r_[firsts, len(suffix)])
        least = np.minimum.reduceat(doc, firsts) if len(firsts) else doc
        again = doc > np.repeat(least, sizes)
        asked = shared[firsts]  # equal strings have equal triggers, hence equal codes
        waiting = np.repeat(asked, sizes) & ~again
        self.start = np.r_[parse.start[sure], place[again]]
        self.stop = np.r_[(parse.start + parse.count + LENGTH - 1)[sure], place[again] + LENGTH]
        self.keys, self.least = suffix[firsts][asked], as_key(least[asked])
        self.place, self.number = place[waiting], np.repeat(np.cumsum(asked) - 1, sizes)[waiting]


def ask_suffixes(chunks: DataFrame, triggers: DataFrame) -> DataFrame:
    """Lists of the suffixes of unsettled phrases."""
    n = ex.n_ranges(chunks)

    def run(batches):
        for row in ex.rows_of(batches):
            known = Known(row)
            yield ex.entry_batch(row["chunk"], [(b, ex.pack_columns((known.keys[i:j], 8), (known.least[i:j], 8)))
                                                for b, i, j in ex.ranges(known.keys, n)])

    return chunks.join(triggers, "chunk").select("chunk", "body", "sizes", "rest", "answers").mapInArrow(tidy(run), ex.ENTRIES)


def settle_suffixes(lists: list[bytes]) -> list[bytes]:
    (suffix, least), lengths = ex.joined_lists(lists, 8, 8)
    order = np.argsort(suffix, kind="stable")
    firsts = ex.group_starts(suffix[order])
    first = np.repeat(np.minimum.reduceat(least[order], firsts), np.diff(np.r_[firsts, len(suffix)]))
    later = np.empty(len(suffix), dtype=np.uint64)
    later[order] = first < least[order]
    return ex.per_list(later, lengths)


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    edges = np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def whole_characters(body: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the bytes of characters that are not gone as a whole."""
    starts = np.flatnonzero((body & 0xC0) != 0x80)
    if not len(starts):
        return gone
    every = np.logical_and.reduceat(gone, starts)
    out = np.repeat(every, np.diff(np.r_[starts, len(body)]))
    return np.r_[np.zeros(len(body) - len(out), dtype=bool), out]


def without_repeats(docs: DataFrame, characters: bool = False) -> DataFrame:
    """``docs``, text replaced by kept (the bytes that stay), with n_bytes, n_removed and spans (start and stop, bytes).

    ``characters``: a character of several bytes stays whole where a run begins or ends inside it.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "spans")
    chunks = ex.pack(docs)
    triggers = staged(ex.answer(ask_triggers(chunks), settle_triggers), "triggers")
    suffixes = ex.answer(ask_suffixes(chunks, triggers), settle_suffixes).withColumnRenamed("answers", "later")
    others = [f for f in docs.schema if f.name != "text"]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([*others, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for row in ex.rows_of(batches):
            body, n = np.frombuffer(row["body"], dtype=np.uint8), len(row["body"])
            gone = np.zeros(n, dtype=bool)
            if row["answers"] is not None:
                known = Known(row)
                start, stop = known.start, known.stop
                if row["later"] is not None:
                    later = np.concatenate([ex.unpack_columns(a["answer"], 1)[0] for a in row["later"]]) > 0
                    place = known.place[later[known.number]]
                    start, stop = np.r_[start, place], np.r_[stop, place + LENGTH]
                gone = covered(n, start, stop)
            if characters:
                gone = whole_characters(body, gone)
            at, removed, spans, kept = 0, [], [], []
            for size in row["sizes"]:
                part = gone[at:at + size]
                edges = np.flatnonzero(np.diff(np.r_[False, part, False]))
                spans.append([{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()])
                removed.append(int(part.sum()))
                kept.append(body[at:at + size][~part].tobytes())
                at += size
            rest = ex.from_ipc(row["rest"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(row["sizes"], type=pa.int64()), pa.array(removed, type=pa.int64()),
                                              pa.array(spans, type=arrow_span), pa.array(kept, type=pa.binary())], names=schema.names)

    return (chunks.join(triggers, "chunk", "left").join(suffixes, "chunk", "left")
            .select("body", "sizes", "rest", "answers", "later").mapInArrow(tidy(run), schema))


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and SHA-256 of the bytes that stay."""
    return without_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
