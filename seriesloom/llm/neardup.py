"""One document of each group of near-duplicates: SimHash and rare shingles propose, the shingles themselves decide.

Texts are near when the Jaccard similarity of their sets of word shingles is SIMILARITY or more. In the order of
(doc_id, row) a text goes if it is near to one before it that stays; so no two that stay are near, and a document goes
only for one that stays. Texts with the same words are one text, whatever their number.

What may be near comes together in groups of two kinds. The components of the fingerprint index (``simhash``) bring most
copies together. A prefix filter brings the rest: in any one order of all shingles, two sets of a similarity of
SIMILARITY share SHARED shingles among the first n - ceil(SIMILARITY * n) + SHARED of each (or all they need to), and
those are even among the first n - ceil(2 * SIMILARITY / (1 + SIMILARITY) * n) + SHARED of the smaller set, about half as many: its
inner ones. A group without an inner entry holds no pair, and of a group's pairs only those count whose smaller set is there with an
inner one. The order puts frequent shingles last, as counted in a sample of the texts, and else goes by hash; it decides
how much is compared, never the result.

A text that is the first of all its groups stays, as none before it can be near. Each round compares those texts with
the members of their groups, and both what stays and what goes leaves the groups: as many comparisons as members. Once
the pairs of all groups are few, or rounds settle little, all pairs of the groups of shingles are compared at once.

Null text is empty; empty texts are copies of one another. Rows without doc_id come after all others. Of repeated rows
one stays. An empty table gives an empty table. Columns whose names begin with "_nd" are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import pieces, remove, scratch, staged, text_bytes, tidy
from seriesloom.llm.simhash import SEED, code_components, with_fingerprints

SHINGLE, BITS, SIMILARITY = 5, 6, 0.8
#: One text of so many is in the sample that orders shingles; times in it that make one frequent; frequent ones that are told apart.
SAMPLE, FREQUENT, TOLD_APART = 16, 4, 1 << 20
#: Shingles that near texts share among the first of their sets.
SHARED = 4
#: Pairs for each entry of a group up to which all are compared; share of the pairs that a round has to settle.
PAIRS, SETTLED = 8, 0.1
#: Pairs of near texts that the driver may order.
FEW = 100_000
#: Longs of 64 rows' bits that are broadcast at most.
WORDS = 1 << 19
_LAST = (1 << 63) - 1
#: Of a pair that shares a shingle, the smaller set has it as an inner one.
_INNER = "(_na <= _nb AND _ina) OR (_nb <= _na AND _inb)"


def shingle_set(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words, A-Z lower-cased; fewer words make one shingle."""
    words = raw.lower().split()
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def prefix(own: np.ndarray, frequent: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set, SHARED of which each near set has among its own first; ``frequent`` (sorted) come last."""
    size = len(own) - math.ceil(least * len(own) - 1e-9) + SHARED
    if not len(own) or size >= len(own):
        return own
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[:size]


def inner_size(n: int, least: float = SIMILARITY) -> int:
    """How many of the first shingles of a set of n are inner ones."""
    return n - math.ceil(2 * least / (1 + least) * n - 1e-9) + SHARED


def _frequent(marked: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts of the sample hold, at most TOLD_APART."""
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingle_set(x, shingle) for x in text_bytes(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["_ndtok"])

    sample = marked.where(F.pmod(F.xxhash64("_ndtext"), F.lit(SAMPLE)) == 0).select("text")
    often = (sample.mapInArrow(tidy(run), "_ndtok long").groupBy("_ndtok").count().where(F.col("count") >= FREQUENT)
             .orderBy(F.col("count").desc(), "_ndtok").limit(TOLD_APART).select("_ndtok").toArrow())
    return np.sort(often.column(0).to_numpy().view(np.uint64))


def _only(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``df`` whose _ndrow is among ``rows`` (distinct _ndrow, staged), with the columns of ``df``.

    Row numbers are dense in each partition, so a bit for each is broadcast and the texts stay where they are. Beyond WORDS longs of
    bits the rows are joined.
    """
    words = rows.groupBy(F.shiftright("_ndrow", 6).alias("_ndword")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_ndrow & 63 as int))")).alias("_ndbits"))
    if words.count() > WORDS:
        return df.join(rows.select("_ndrow"), "_ndrow", "left_semi")
    found = df.withColumn("_ndword", F.shiftright("_ndrow", 6)).join(F.broadcast(words), "_ndword")
    return found.where(F.expr("shiftrightunsigned(_ndbits, cast(_ndrow & 63 as int)) & 1 = 1")).select(df.columns)


def _prefixes(marked: DataFrame, shingle: int, least: float, texts: DataFrame) -> DataFrame:
    """_ndrow, _ndid, _fp, _ndn (size of the set) and _ndfirst (its first shingles) of the rows of ``texts``."""
    frequent = marked.sparkSession.sparkContext.broadcast(_frequent(marked, shingle))

    def run(batches):
        late = frequent.value
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingle_set(x, shingle) for x in text_bytes(part.column(3))]
                first = [prefix(x, late, least).view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(list(map(len, sets)), type=pa.int64()), pa.array(first, type=pa.list_(pa.int64()))],
                                                 names=["_ndrow", "_ndid", "_fp", "_ndn", "_ndfirst"])

    return _only(marked.select("_ndrow", "_ndid", "_fp", "text"), texts).mapInArrow(
        tidy(run), "_ndrow long, _ndid long, _fp long, _ndn long, _ndfirst array<long>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """_ndrow and the shingle set of the rows' texts, as binary."""
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingle_set(x, shingle).tobytes() for x in text_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, type=pa.binary())], names=["_ndrow", "_ndset"])

    return rows.select("_ndrow", "text").mapInArrow(tidy(run), "_ndrow long, _ndset binary")


def _near(pairs: DataFrame, marked: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs`` (staged; _a, _b and further columns) whose texts are near, staged."""
    columns = pairs.columns

    def run(batches):
        for batch in batches:
            near = [similarity(np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64)) >= least
                    for a, b in zip(batch.column(len(columns)), batch.column(len(columns) + 1))]
            yield batch.select(columns).filter(pa.array(near, type=pa.bool_()))

    with scratch():
        rows = staged(pairs.select(F.col("_a").alias("_ndrow")).unionByName(pairs.select(F.col("_b").alias("_ndrow"))).distinct(), "rows")
        sets = staged(_sets(_only(marked.select("_ndrow", "text"), rows), shingle), "sets")
        both = (pairs.join(sets.select(F.col("_ndrow").alias("_a"), F.col("_ndset").alias("_seta")), "_a")
                .join(sets.select(F.col("_ndrow").alias("_b"), F.col("_ndset").alias("_setb")), "_b"))
        return staged(both.select(*columns, "_seta", "_setb").mapInArrow(tidy(run), pairs.schema), "near", outer=True)


def _entries(marked: DataFrame, texts: DataFrame, shingle: int, bits: int, least: float) -> DataFrame:
    """_kind (0 shingle, 1 fingerprints), _at (place of the shingle), _in (an inner one), _tok, _ndid, _ndrow, _ndn: the members of all
    groups that may hold a pair. What is exchanged by shingle are narrow rows, once; ids and sizes join what is left of them."""
    with scratch():
        first = staged(_prefixes(marked, shingle, least, texts), "prefixes")
        inner = F.col("_ndn") - F.ceil(F.col("_ndn") * F.lit(2 * least / (1 + least)) - F.lit(1e-9)) + SHARED
        tokens = first.select("_ndrow", inner.alias("_inner"), F.posexplode("_ndfirst").alias("_at", "_tok")).select(
            F.lit(0).alias("_kind"), "_at", (F.col("_at") < F.col("_inner")).alias("_in"), "_tok", "_ndrow")
        roots = staged(code_components(texts.select("_fp").distinct(), bits), "roots")
        rooted = first.join(roots, "_fp", "left").select(F.lit(1).alias("_kind"), F.lit(0).alias("_at"), F.lit(True).alias("_in"),
                                                         F.coalesce("_root", "_fp").alias("_tok"), "_ndrow")
        found = []
        for members in (tokens, rooted):
            group = Window.partitionBy("_tok")
            several = members.withColumns({"_c": F.count(F.lit(1)).over(group), "_some": F.max("_in").over(group)}).where("_c > 1 AND _some")
            found.append(several.select("_kind", "_at", "_in", "_tok", "_ndrow"))
        some = staged(found[0].unionByName(found[1]), "members")
        return staged(some.join(first.select("_ndrow", "_ndid", "_ndn"), "_ndrow"), "entries", outer=True)


def _possible(found: DataFrame, least: float, *further: str) -> DataFrame:
    """Distinct pairs _a, _b of ``found`` (_kind, _ata, _atb, _na, _nb for each shared group) that may be near.

    Up to the last shared shingle all shared ones are known, and beyond it no more are shared than the shorter rest holds.
    """
    pairs = found.groupBy("_a", "_b", "_na", "_nb", *further).agg(
        F.max("_kind").alias("_kind"), F.count(F.when(F.col("_kind") == 0, 1)).alias("_both"), F.max("_ata").alias("_ata"), F.max("_atb").alias("_atb"))
    most = F.col("_both") + F.least(F.col("_na") - F.col("_ata"), F.col("_nb") - F.col("_atb")) - 1
    alike = F.least("_na", "_nb") >= F.greatest("_na", "_nb") * F.lit(least - 1e-9)
    shared = F.col("_both") >= F.least(F.lit(SHARED), F.ceil(F.greatest("_na", "_nb") * F.lit(least) - F.lit(1e-9)))
    enough = shared & (most >= (F.col("_na") + F.col("_nb")) * F.lit(least / (1 + least)) - F.lit(1e-6))
    return pairs.where(alike & (enough | (F.col("_kind") == 1))).select("_a", "_b", *further)


def _ordered(edges: DataFrame, few: int) -> list[DataFrame]:
    """_ndrow of the texts that go, from all near pairs: _a before _b in order, with the ids _ida and _idb."""
    gone = []
    while (n := edges.count()) > few:
        later = edges.select(F.col("_b").alias("_a"))
        now = staged(edges.join(later, "_a", "left_anti").select(F.col("_b").alias("_ndrow")).distinct(), "going")
        gone.append(now)
        edges = staged(edges.join(now.select(F.col("_ndrow").alias("_b")), "_b", "left_anti")
                       .join(now.select(F.col("_ndrow").alias("_a")), "_a", "left_anti"), "edges")
    if n:
        out: set[int] = set()
        for _, _, a, b in sorted((r["_idb"], r["_b"], r["_a"], r["_b"]) for r in edges.collect()):
            if a not in out:
                out.add(b)
        gone.append(edges.sparkSession.createDataFrame(pa.table({"_ndrow": pa.array(sorted(out), type=pa.int64())})))
    return gone


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, least: float = SIMILARITY, few: int = FEW, pairs: int = PAIRS) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; the columns of ``docs``."""
    columns = docs.columns
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r" + upper, " " * 5 + lower)
    key = F.array_join(F.array_remove(F.split(words, " "), ""), " ")
    marked = with_fingerprints(docs, shingle).withColumn("_ndtext", F.sha2(key, 256)).withColumn(
        "_ndrow", F.monotonically_increasing_id()).withColumn("_ndid", F.coalesce("doc_id", F.lit(_LAST)))
    marked = staged(marked, "marked")  # the row numbers are fixed from here on
    with scratch():
        texts = staged(marked.groupBy("_fp", "_ndtext").agg(F.min(F.struct("_ndid", "_ndrow")).alias("_f"))
                       .select("_fp", "_f._ndid", "_f._ndrow"), "texts")
        with scratch(keep=True) as held:  # the entries that are left, replaced in each round
            left = _entries(marked, texts, shingle, bits, least)
        gone, weight = [], math.inf
        while True:
            with scratch():
                groups = staged(left.groupBy("_kind", "_tok").agg(
                    F.min(F.struct("_ndid", "_ndrow", "_ndn", "_at", "_in")).alias("_f"), F.count("*").alias("_c"), F.count_if("_in").alias("_ci"))
                    .where("_c > 1 AND _ci > 0"), "groups")
                last, (n, weight) = weight, groups.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.coalesce(F.sum(F.expr("_ci * (_c - 1) - _ci * (_ci - 1) / 2")), F.lit(0)).cast("double")).first()  # pairs with an inner entry
                if weight <= pairs * n or weight > (1 - SETTLED) * last:
                    break
                asks = staged(left.join(groups, ["_kind", "_tok"]).where(F.col("_f._ndrow") != F.col("_ndrow")).select(
                    "_kind", F.col("_f._ndrow").alias("_a"), F.col("_ndrow").alias("_b"), F.col("_f._ndn").alias("_na"), F.col("_ndn").alias("_nb"),
                    F.col("_f._at").alias("_ata"), F.col("_at").alias("_atb"), F.col("_f._in").alias("_ina"), F.col("_in").alias("_inb")), "asks")
                # the first of all its groups stays, and asks in all groups that it shares with another
                first = staged(asks.select("_a").distinct().join(asks.select(F.col("_b").alias("_a")), "_a", "left_anti"), "first")
                near = _near(staged(_possible(asks.where(_INNER).join(first, "_a", "left_semi"), least), "compared"), marked, shingle, least)
                now = staged(near.select(F.col("_b").alias("_ndrow")).distinct(), "going", outer=True)
                gone.append(now)
                before = list(held)
                held.clear()
                with scratch(keep=True) as held_now:
                    left = staged(left.join(now.unionByName(first.select(F.col("_a").alias("_ndrow"))), "_ndrow", "left_anti"), "left")
                held += held_now
                remove(before)
        if n:
            member = left.where(F.col("_kind") == 0).select("_kind", "_tok", "_ndid", "_ndrow", "_ndn", "_at", "_in")
            one = member.toDF("_kind", "_tok", "_ida", "_a", "_na", "_ata", "_ina")
            two = member.drop("_kind").toDF("_tok", "_idb", "_b", "_nb", "_atb", "_inb")
            before = (F.col("_ida") < F.col("_idb")) | ((F.col("_ida") == F.col("_idb")) & (F.col("_a") < F.col("_b")))
            alike = F.least("_na", "_nb") >= F.greatest("_na", "_nb") * F.lit(least - 1e-9)
            every = staged(_possible(one.join(two, "_tok").where(before & alike & F.expr(_INNER)), least, "_ida", "_idb"), "pairs")
            gone += _ordered(_near(every, marked, shingle, least), few)
        stays = texts.select("_ndrow")
        for some in gone:
            stays = stays.join(some, "_ndrow", "left_anti")
        kept = _only(marked, staged(stays, "stays", outer=True)).select(*columns)
        remove(held)
    return kept
