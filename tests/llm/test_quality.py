import re

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words, where = WORD.findall(text), {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i:i + 5]), []).append(i)
    inside = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_statistics_equal_plain_python(odd_docs, spark):
    rnd = np.random.default_rng(1)
    more = [(1000 + i, " ".join(rnd.choice(list("abc#"), 40)) + "\nx y\n x y\nx y", None, None, None) for i in range(30)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema))
    for r in quality.with_statistics(docs).collect():
        assert tuple(r[s] for s in quality.STATISTICS[:5]) == plain(r["text"] or "")


def test_many_distinct_words_do_not_overflow():
    ids = np.r_[np.arange(30_000), np.arange(5)]
    assert quality.repeat_words(ids, 1 << 40) == quality.repeat_words(ids, 30_000) == 10


def test_rules_separate_and_read_the_same_in_spark(spark):
    rnd = np.random.default_rng(2)
    low = [(i, " ".join(["LOUD!!"] * 0 + [w.upper() + "!!" for w in rnd.choice(["ab", "cde", "fgh", "i", "jk", "lm"], 30)]), None, None, None) for i in range(300)]
    high = [(300 + i, " ".join(rnd.choice(["some", "plain", "words", "of", "a", "text", "here"], 60)), None, None, None) for i in range(900)]
    docs = spark.createDataFrame(low + high, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.range(0, 1200).select(F.col("id").alias("doc_id"), (F.col("id") >= 300).cast("int").alias("quality"))
    rules = quality.fit(docs, labels)
    assert rules and all(isinstance(c, quality.Condition) for r in rules for c in r)
    got = quality.judged(docs, rules).collect()
    x = {s: np.array([r[s] for r in got]) for s in quality.STATISTICS}
    fits = np.zeros(len(got), dtype=bool)
    for rule in rules:
        fits |= quality.covers(rule, x)
    assert [r["kept"] for r in got] == [not r["base_failed"] and not f for r, f in zip(got, fits)]
    assert all(r["base_failed"] or r["kept"] == (r["doc_id"] >= 300) for r in got)


def test_no_labels_and_no_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (5, 1, None), (77, 0, 1)], none.schema)
    for labels in (none, odd):
        got = quality.quality_verdicts(odd_docs.withColumn("kept", F.lit(1)), labels).collect()
        assert len(got) == odd_docs.count() and all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.quality_verdicts(no_docs, odd).count() == 0
