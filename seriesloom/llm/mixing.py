"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Every document gets an exponential key, -ln(u) / quality weight, from a hash of its id and text, so reruns agree.
Within a source the documents are taken in ascending order of key. A target of at least the source's size first
takes the whole source that many times; the rest takes documents by key until the prefix sum of sizes reaches it,
cutting the last one to the words that are left.

The prefix sum is two-level, so that no source has to fit in one task: sizes are summed for each (source, slice of
the key space), the running sums over the slices tell which are taken whole and which one is cut, and only the rows
of that one slice are put in order.

Sources are ordered by code point, null last, and take the weights in turn. An empty table gives an empty table;
null text has size 0 and is never taken; rows that repeat are documents of their own; a source of size 0 has target
0. Columns that clash with those added (ADDED) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.llm.common import staged, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SLICES = 4096
SEED = 20240607
#: Sources whose plan may be broadcast (well under 100 bytes each).
BROADCAST_SOURCES = 100_000
ADDED = ("size", "source_size", "target", "taken")


def natural_words(text: Column, size: Column) -> Column:
    """Default quality weight: 1 where the mean word has 3 to 12 characters with its space, else a quarter."""
    return F.when(F.char_length(text).between(size * 3, size * 12), F.lit(1.0)).otherwise(F.lit(0.25))


def measured(docs: DataFrame, quality=natural_words, seed: int = SEED) -> DataFrame:
    """``docs`` with size (words), _key (exponential key) and _slice (part of the key space)."""
    docs = docs.drop(*ADDED, "_key", "_slice").withColumn("size", word_count(F.col("text")))
    drawn = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    uniform = (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return (docs.withColumn("_key", -F.log(uniform) / quality(F.col("text"), F.col("size")))
            .withColumn("_slice", F.floor((1 - F.exp(-F.col("_key"))) * SLICES).cast("int")))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """_source, source_size, target: one row for each source.

    Filling by weight with a ceiling has a closed form: in ascending order of ceiling per weight, a source is at
    its ceiling as long as that ratio is at most what is left for it and those behind it, per weight.
    """
    sources = sized.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))  # one row for each source
    everything = Window.partitionBy()
    ranked = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1)))
    ranked = ranked.withColumn("_ceiling", F.col("source_size") * F.lit(float(most)))
    before = (Window.orderBy((F.col("_ceiling") / F.col("_w")).asc(), F.col("_source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_ceiling").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    filled = (ranked.withColumn("_level", left / weight_left)
              .withColumn("_full", F.col("_ceiling") / F.col("_w") <= F.col("_level")))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    return filled.select("_source", "source_size",
                         F.when(F.col("_full"), F.col("_ceiling")).otherwise(level * F.col("_w")).alias("target"))


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For each source: source_size, target, _epochs, _rest (words beyond them), _cut (slice) and _ahead (words before it)."""
    goal = F.round("target").cast("long")
    sources = (targets(sized, weights, share, most)
               .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
               .withColumn("_rest", goal - F.col("_epochs") * F.col("source_size")))
    slices = sized.groupBy(F.col("source").alias("_s"), "_slice").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("_s").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("_upto", F.sum("_words").over(upto))
    cut = (sources.join(slices, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_upto") > F.col("_rest")), "left")
           .groupBy("_source", "source_size", "target", "_epochs", "_rest")
           .agg(F.min("_slice").alias("_cut"), F.min(F.col("_upto") - F.col("_words")).alias("_ahead")))
    return cut


def mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sized`` (see ``measured``; staged, as it is read several times) with source_size, target and taken words."""
    kept = [c for c in sized.columns if c not in ("_key", "_slice")]
    # one row for each source; counted before it is broadcast, more of them are joined by source
    planned = staged(plan(sized, weights, share, most), "plan")
    if planned.count() <= BROADCAST_SOURCES:
        planned = F.broadcast(planned)
    joined = sized.join(planned, sized["source"].eqNullSafe(F.col("_source")))
    whole = joined.where(F.col("_cut").isNull() | (F.col("_slice") != F.col("_cut"))).withColumn(
        "taken", F.col("size") * (F.col("_epochs") + F.when(F.col("_slice") < F.col("_cut"), 1).otherwise(0)))
    before = (Window.partitionBy("source").orderBy("_key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.col("_ahead") + F.coalesce(F.sum("size").over(before), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - ahead))
    cut = joined.where(F.col("_slice") == F.col("_cut")).withColumn("taken", F.col("size") * F.col("_epochs") + part)
    return whole.unionByName(cut).select(*kept, "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """The mix as rows: every document as many times as it is taken, a cut one if at least half of it is."""
    mixed = mix(staged(measured(docs), "sized"), **settings)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return (mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies)))
            .select(*[c for c in docs.columns]))


def taken_words(docs: DataFrame) -> DataFrame:
    sized = staged(measured(docs.select("doc_id", "source", "text")).drop("text"), "sized")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")
