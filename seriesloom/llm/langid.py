"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lower-cased, its runs of other characters than letters become one space, and its character n-grams of 1 to
ORDER characters are hashed to FEATURES columns. The value of a column is its share of the text's n-grams times the
inverse document frequency of the column. Weights are learned by FTRL-proximal (follow the regularised leader) with an
elastic net: the L1 part leaves most weights at exactly 0. A temperature, fitted on training rows that FTRL did not
see, scales the logits, and score is the largest calibrated probability.

Document frequencies cover all training texts. FTRL and the temperature see at most SAMPLE training texts of each
language, chosen by a hash of the id; both are fitted on their n-gram counts, of which a text has at most FEATURES.
Texts are predicted whole. Only text is an input of a prediction.

A text that is null or has no letter is ``und`` with score 0, as is every text if no training row has a language.
Repeated rows are predicted alike. Training rows are those whose crc32(doc_id as text) mod 4 is not 2 and whose lang is
not null; a null doc_id counts as the empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.llm.common import id_text, pieces, staged

FEATURES, ORDER, BLOCK = 1 << 16, 3, 1 << 20
#: Training texts of each language that fit the weights, at most.
SAMPLE = 1500
#: FTRL-proximal: step, smoothing, L1 and L2; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 0.2, 0.02, 3
FOLDS, HELD = 4, 2
BROADCAST_LANGUAGES = 100_000
_SEEDS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def held_out(doc_id: Column) -> Column:
    return id_text(doc_id) % FOLDS == HELD


def _letter_table() -> np.ndarray:
    """For each character: itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32)


_LETTERS = _letter_table()


def blocks_of(text: str) -> list[str]:
    """A text of more than BLOCK characters in parts of that many, as if spaces stood between them."""
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


def column_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a text's n-grams and how often each is there."""
    if len(text) <= BLOCK:
        return np.unique(ngrams(text), return_counts=True)
    counts = sum(np.bincount(ngrams(t), minlength=FEATURES) for t in blocks_of(text))
    return np.flatnonzero(counts), counts[counts > 0]


def ngrams(text: str) -> np.ndarray:
    """Columns of all n-grams of a text of up to BLOCK characters; none if it has no letter."""
    codes = _LETTERS[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
    space = codes == 32
    if space.all():
        return np.zeros(0, dtype=np.int64)
    keep = ~space
    keep[1:] |= ~space[:-1]
    codes = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint32)
    out, h = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(ORDER):
        h = (h[:len(codes) - n] ^ codes[n:]) * np.uint32(_SEEDS[n % 3])
        h ^= h >> np.uint32(15)
        out.append(h % np.uint32(FEATURES))
        h = h[:-1]
    return np.concatenate(out).astype(np.int64)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each column, and all texts; tasks hand on counts, which Spark sums by column."""
    def run(batches):
        df = np.zeros(FEATURES + 1, dtype=np.int64)  # the last one counts texts
        there = np.zeros(FEATURES + 1, dtype=bool)
        for batch in batches:
            for text in batch.column(0):
                for part in blocks_of(text.as_py()):
                    there[ngrams(part)] = True
                there[FEATURES] = True
                df += there
                there[:] = False
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(df[found])], names=["column", "n"])

    total = np.zeros(FEATURES + 1, dtype=np.int64)
    for row in train.select("text").mapInArrow(run, "column int, n long").groupBy("column").agg(F.sum("n").alias("n")).collect():
        total[row["column"]] = row["n"]  # at most FEATURES + 1 rows
    return total[:FEATURES], int(total[FEATURES])


def sampled(train: DataFrame, sample: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """lang, columns and counts of up to ``sample`` texts of each language.

    The hash of the id decides. Its range is first narrowed so that about twice as many rows of a language are left
    as are wanted, so that no language is put in order as a whole.
    """
    ids = train.select("doc_id", "lang")
    counts = ids.groupBy("lang").agg(F.count("*").alias("_n"))
    counts = staged(counts, "languages")
    if counts.count() <= BROADCAST_LANGUAGES:  # one row for each language, counted before it is broadcast
        counts = F.broadcast(counts)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = ids.join(counts, "lang").where(drawn * F.col("_n") < F.lit(float(1 << 31) * sample))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    by_draw = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    chosen = few.withColumn("_n", F.row_number().over(by_draw)).where(F.col("_n") <= sample)
    # ids and languages only: at most ``sample`` rows of each language are broadcast
    rows = train.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [column_counts(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([c.astype("<u2").tobytes() for c, _ in found], type=pa.binary()),
                     pa.array([n.astype("<u4").tobytes() for _, n in found], type=pa.binary())], names=["doc_id", "lang", "columns", "counts"])

    counted = (rows.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, columns binary, counts binary")
               .withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= sample))
    out = [(r["lang"], np.frombuffer(r["columns"], dtype="<u2").astype(np.int64), np.frombuffer(r["counts"], dtype="<u4"))
           for r in counted.select("doc_id", "lang", "columns", "counts").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "columns").toLocalIterator()]
    return [x for x in out if len(x[1])]


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal; weights are FEATURES + 1 (bias) times languages."""

    def __init__(self, languages: int):
        self.z = np.zeros((FEATURES + 1, languages))
        self.n = np.zeros((FEATURES + 1, languages))

    def weights(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, columns: np.ndarray, values: np.ndarray, language: int) -> None:
        rows, x = np.r_[columns, FEATURES], np.r_[values, 1.0]
        w = self.weights(rows)
        p = softmax((x @ w)[None, :])[0]
        p[language] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, language: np.ndarray) -> float:
    """Factor on the logits with the least log loss, by golden section over its logarithm."""
    def loss(t):
        return -np.log(np.maximum(softmax(logits * np.exp(t))[np.arange(len(language)), language], 1e-12)).mean()
    low, high, ratio = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(train: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and logits by column: idf, weights and temperature multiplied out, the bias last."""
    rows = sampled(train, sample)
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return [], np.zeros((FEATURES + 1, 1))
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    # 30: TF-IDF values of a text are shares, far below 1; the steps of FTRL suit values near 1
    examples = [(c, 30 * k / k.sum() * idf[c], languages.index(lang)) for lang, c, k in rows]
    fitting, checking = [e for i, e in enumerate(examples) if i % 5], examples[::5]
    model = Ftrl(len(languages))
    for _ in range(PASSES):
        for columns, values, language in fitting:
            model.learn(columns, values, language)
    w = model.weights(np.arange(FEATURES + 1))
    logits = np.array([v @ w[c] + w[FEATURES] for c, v, _ in checking])
    t = temperature(logits, np.array([language for _, _, language in checking]))
    return languages, np.vstack([30 * w[:FEATURES] * idf[:, None], w[FEATURES:]]) * t


def predicted(docs: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of each text."""
    broadcast = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # FEATURES + 1 rows

    def run(batches):
        weights = broadcast.value
        for batch in batches:
            for part in pieces(batch, "text"):
                names, scores = [], []
                for text in part.column(1).to_pylist():
                    total, n = np.zeros(weights.shape[1]), 0
                    for block in blocks_of(text or "") if languages else ():
                        found = ngrams(block)
                        total += weights[found].sum(axis=0, dtype=np.float64)
                        n += len(found)
                    if not n:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    p = softmax((total / n + weights[-1])[None, :])[0]
                    names.append(languages[int(p.argmax())])
                    scores.append(float(p.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages_of(docs: DataFrame) -> DataFrame:
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    return predicted(docs, *fit(train)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
