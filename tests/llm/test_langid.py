import zlib

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm import langid


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages_of(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()


def test_odd_rows(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in langid.languages_of(odd_docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 11))
    assert got[5]["lang_pred"] in ("en", "fr")
    assert langid.languages_of(no_docs).count() == 0
    assert len(langid.ngrams("😀 — 12 ²")) == 0 and len(langid.ngrams("𝒜")) > 0
    unknown = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.languages_of(unknown).collect()} == {"und"}


def test_l1_leaves_most_weights_at_zero_and_temperature_fits():
    rnd, model = np.random.default_rng(1), langid.Ftrl(2)
    for k in range(400):
        y = k % 2
        columns = np.unique(np.r_[y * 10 + rnd.integers(0, 5, 3), 100 + rnd.integers(0, 5000, 20)])
        model.learn(columns, np.full(len(columns), 0.2), y)
    w = model.weights(np.arange(langid.FEATURES + 1))
    assert (w[:langid.FEATURES] != 0).any(axis=1).sum() < 3000 and w[1, 0] > w[1, 1] and w[11, 1] > w[11, 0]
    logits = rnd.normal(size=(4000, 2))
    language = (rnd.random(4000) < langid.softmax(3 * logits)[:, 1]).astype(int)
    assert abs(langid.temperature(logits, language) - 3) < 0.5


def test_blocks_of_a_long_text():
    text = "ab " * (langid.BLOCK // 2)
    columns, counts = langid.column_counts(text)
    assert counts.sum() > langid.BLOCK and len(columns) < 20
