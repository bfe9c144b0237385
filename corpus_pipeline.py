"""A corpus, from raw documents to token ids: five stages, each an operator of ``seriesloom.llm``.

Every stage is a function of (spark, docs, sf_dir), where docs is what the stage before it kept; ``run`` writes the
result of each stage to the shared folder and reads it again for the next. A stage that is lost with its executors is
repeated from its input there. What a stage keeps in the shared folder for its lazy result goes when the next stage begins, as that
result is written by then.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import bpe, mixing, neardup, quality, spans
from seriesloom.llm.common import new_folder, remove, scratch, ship_code

_HELD: list = []


def stage(fn):
    """A stage that first removes what the one before it left, and lists what it leaves itself."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_code(spark)
        remove([x for x in _HELD if x[0] is spark])
        with scratch(keep=True) as made:
            out = fn(spark, docs, sf_dir)
        _HELD[:] = made
        return out
    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the decision list learned from the labels keep."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(docs, rules).where(F.col("kept")).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8 or more)."""
    return neardup.without_near_copies(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 bytes or more that a document of a smaller id holds; n_chars follows."""
    kept = spans.without_repeats(docs, characters=True).withColumn("text", F.col("kept").cast("string"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


@stage
def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixture(docs)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' other columns, ids (little-endian unsigned 32-bit), n_tokens, and the text decoded from the ids."""
    tokens = bpe.decode(bpe.encode(docs))
    return tokens.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mixture),
    ("BPE encoding", token_ids),
]

#: Learned rules, fingerprints and BPE are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; only the last one's result stays in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES:
        with scratch(keep=True) as made:
            folder = new_folder(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.option("compression", "zstd").parquet(folder)
        docs = spark.read.parquet(folder)
        remove(before)
        before = made
    remove(_HELD)
    return docs
