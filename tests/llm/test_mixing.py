import re
from collections import defaultdict

from pyspark.sql import functions as F

from seriesloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, rest, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), list(order)
    while rest > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += rest * w[s] / total
        rest = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        for s in free:
            target[s] = min(target[s], most * sizes[s])
        free = [s for s in free if target[s] < most * sizes[s] - 1e-9]
    return target


def check(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = filled(sizes)
    got = mixing.mix(mixing.measured(docs)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    return got


def test_odd_rows(odd_docs):
    first, again = check(odd_docs), check(odd_docs.repartition(5))
    assert sorted(map(str, first)) == sorted(map(str, again))  # reruns agree


def test_whole_epochs_come_first(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "s0" if i % 3 == 0 else f"s{i % 11}", 0) for i in range(3000)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        epochs = int(own[0]["target"] // own[0]["source_size"])
        parts = [r for r in own if r["taken"] not in (epochs * r["size"], (epochs + 1) * r["size"])]
        assert len(parts) <= 1  # the cut document


def test_quality_weights_decide_who_is_taken(spark):
    rows = [(i, "word " * 10 if i % 2 else "w " * 10, "en", s, 0) for s in ("a", "b", "c") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r for r in mixing.mix(mixing.measured(docs)).collect() if r["source"] == "b"]  # the target is 3333 of its 4000 words
    natural = sum(r["taken"] for r in got if r["doc_id"] % 2)
    assert natural > 1900 and sum(r["taken"] for r in got) - natural < 1500


def test_mixture_repeats_rows_and_keeps_columns(odd_docs, no_docs):
    got = mixing.mixture(odd_docs.withColumn("size", F.lit("x")))
    assert set(odd_docs.columns) <= set(got.columns) and got.count() > 0
    assert mixing.mixture(no_docs).count() == 0 and mixing.taken_words(no_docs).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = mixing.mix(mixing.measured(odd_docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
