"""The stages, each on its own input against plain Python; the registered names; the library without this package."""

import glob
import os
import random
import re
import shutil
import subprocess
import sys
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from seriesloom.llm import common, neardup, quality

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before and after every stage."""
    base, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert result.dtypes == docs.dtypes
        result.write.parquet(str(base / str(k)))
        docs = spark.read.parquet(str(base / str(k)))
        out.append(docs.collect())
    return out


def test_quality_stage_keeps_what_the_query_keeps(spark, steps):
    rows = quality.quality_verdicts(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r["doc_id"] for r in steps[1]} == {r["doc_id"] for r in rows if r["kept"]}
    assert len(steps[1]) < len(steps[0])


def test_near_duplicates_go_only_for_one_that_stays(steps):
    sets = {r["doc_id"]: neardup.shingle_set((r["text"] or "").encode()) for r in steps[1]}
    stays = {r["doc_id"] for r in steps[2]}
    assert len(stays) == len(steps[2])
    for gone in set(sets) - stays:
        assert any(neardup.similarity(sets[gone], sets[s]) >= 0.8 for s in stays if s < gone)
    close = sum(neardup.similarity(sets[a], sets[b]) >= 0.95 for a in stays for b in stays if a < b)
    assert close == 0


def test_without_near_duplicates_what_follows_differs(spark, steps):
    """The stages after it, run on what went into it instead of what it kept."""
    docs = spark.createDataFrame(steps[1], spark.read.parquet(f"{SF}/documents.parquet").schema)
    passages = corpus_pipeline.repeated_passages(spark, docs, SF).collect()
    assert len(passages) == len(steps[1]) > len(steps[3]) == len(steps[2])
    docs = spark.createDataFrame(passages, docs.schema)
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.source_mixture(spark, docs, SF).collect())
    assert mixed != Counter(r["doc_id"] for r in steps[4]) and set(mixed) - {r["doc_id"] for r in steps[2]}


def test_no_near_pair_stays_and_the_order_decides(spark):
    """Texts of a family share most words, far beyond the reach of the fingerprints; some words are in a third of all."""
    rnd, rows = random.Random(7), []
    common = [f"c{k}" for k in range(60)]
    for family in range(60):
        base = [f"f{family}w{k}" for k in range(150)]
        for _ in range(6):
            words = list(base)
            for _ in range(rnd.randint(0, 5)):
                words[rnd.randrange(150)] = f"x{rnd.random()}"
            rows.append(" ".join(words + (common if family % 3 == 0 else [])))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    sets = {i: neardup.shingle_set(text.encode()) for i, text in enumerate(rows)}
    want: list[int] = []
    for i in sorted(sets):
        if all(neardup.similarity(sets[i], sets[s]) < 0.8 for s in want):
            want.append(i)
    assert 60 < len(want) < len(rows)
    assert sorted(r["doc_id"] for r in neardup.without_near_copies(docs).collect()) == want
    assert sorted(r["doc_id"] for r in neardup.without_near_copies(docs, few=0, pairs=0).collect()) == want


def test_a_template_is_compared_in_proportion(spark, monkeypatch):
    """Texts of one template, each with words of its own, are not near; twice as many make about twice the comparisons."""
    rnd, seen = random.Random(8), []
    plain = neardup._near

    def counted(pairs, *rest):
        seen[-1] += pairs.count()
        return plain(pairs, *rest)

    monkeypatch.setattr(neardup, "_near", counted)
    template = [f"t{k}" for k in range(104)]
    for n in (500, 2000):
        seen.append(0)
        rows = [(i, " ".join(template + [f"o{rnd.random()}" for _ in range(20)])) for i in range(n)]
        assert neardup.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count() == n
    assert seen[1] <= 6 * seen[0] + 4 * 2000


def test_shuffle_files_go_once_their_rows_are_staged(spark):
    folders = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before = files()
    with common.scratch():
        rows = common.staged(spark.range(100_000).repartition(4, "id").groupBy(F.col("id") % 1000).count(), "some")
        end = time.time() + 10
        while files() - before and time.time() < end:
            time.sleep(0.1)
        assert not files() - before
        assert rows.count() == 1000


def test_scratch_goes_with_the_next_stage(spark, steps):
    from pathlib import Path
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = {p.name for p in base.iterdir()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    left = {p.name.split("-")[0] for p in base.iterdir() if p.name not in before}
    assert left == {"marked", "stays"}
    assert kept.count() < docs.count()
    corpus_pipeline.source_mixture(spark, docs, SF)
    assert not any(p.name.startswith(("marked-", "stays-")) for p in base.iterdir() if p.name not in before)
    assert corpus_pipeline.run(spark, SF).count() == len(steps[5])
    assert not any(p.name.startswith(("marked-", "stays-", "entries-", "chunks-")) for p in base.iterdir() if p.name not in before)


def test_the_pipeline_leaves_no_near_pair(steps):
    sets = [neardup.shingle_set((r["text"] or "").encode()) for r in steps[2]]
    assert not any(neardup.similarity(a, b) >= 0.8 for k, a in enumerate(sets) for b in sets[:k])


def test_repeated_passages_are_cut_on_whole_characters(steps):
    before, after = {r["doc_id"]: r["text"] for r in steps[2]}, {r["doc_id"]: r for r in steps[3]}
    assert before.keys() == after.keys()
    seen: set[bytes] = set()
    for d in sorted(before):
        raw, own = before[d].encode(), set()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 49):
            if raw[i:i + 50] in seen:
                gone[i:i + 50] = True
            own.add(raw[i:i + 50])
        seen |= own
        at, kept = 0, []
        for c in before[d]:
            size = len(c.encode())
            if not gone[at:at + size].all():
                kept.append(c)
            at += size
        assert after[d]["text"] == "".join(kept) and after[d]["n_chars"] == len(kept)


def test_mix_repeats_whole_documents_near_the_targets(steps):
    words = {r["doc_id"]: len(r["text"].encode().split()) for r in steps[3]}
    copies = Counter(r["doc_id"] for r in steps[4])
    assert set(copies) <= set(words) and max(copies.values()) <= 2
    assert {(r["doc_id"], r["text"]) for r in steps[4]} <= {(r["doc_id"], r["text"]) for r in steps[3]}
    total = sum(words.values())
    largest = max(words.values())
    sources = {r["source"] for r in steps[3]}
    assert abs(sum(words[d] * n for d, n in copies.items()) - 1.5 * total) <= largest * len(sources)


def test_tokens_are_those_of_the_library_and_decode_to_the_text(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(r["decoded"] for r in steps[5]) == sorted(r["text"] for r in steps[4])
    for r in steps[5]:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert ids == library.encode(r["decoded"], add_special_tokens=False).ids and r["n_tokens"] == len(ids)


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert start is odd_docs or docs.count() == 0


def test_every_operator_is_registered_once():
    names = list(entry.queries())
    assert "pipeline" in names
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))


def test_the_library_stands_without_this_package(tmp_path):
    shutil.copytree(f"{ROOT}/seriesloom", tmp_path / "seriesloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 120 and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def _members(spark, monkeypatch, docs):
    """What near-dedup keeps, the plan of its result and that of the members of its groups."""
    plans, plain = {}, neardup.staged

    def watched(df, name, outer=False):
        if name == "members":
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name, outer)

    monkeypatch.setattr(neardup, "staged", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the tables are large
    try:
        out = neardup.without_near_copies(docs)
        plans["result"] = out._jdf.queryExecution().executedPlan().toString()
        return sorted(r["doc_id"] for r in out.collect()), plans
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_stay_where_they_are_and_shingles_are_exchanged_once(spark, monkeypatch):
    rnd, rows = random.Random(9), []
    for k in range(120):
        words = [f"f{k % 50}w{j}" for j in range(120)]
        words[rnd.randrange(120)] = f"x{k % 90}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows + rows[:7], "doc_id long, text string").repartition(5)
    kept, plans = _members(spark, monkeypatch, docs)
    assert len(kept) == 50
    assert "hashpartitioning(_ndrow" not in plans["result"]
    assert plans["members"].count("hashpartitioning(_tok") == 2  # shingles and fingerprints, once each
    monkeypatch.setattr(neardup, "WORDS", 0)  # too many rows for bits: they are joined
    joined, plans = _members(spark, monkeypatch, docs)
    assert joined == kept and "hashpartitioning(_ndrow" in plans["result"]


def test_rows_are_found_by_their_bits(spark):
    rows = [0, 1, 62, 63, 64, 127, (1 << 33) + 63, (1 << 33) + 64, (5 << 33) + 5]
    some = spark.createDataFrame([(x, f"t{x}") for r in rows for x in (r, r + 1000)], "_ndrow long, text string")
    wanted = spark.createDataFrame([(r,) for r in rows], "_ndrow long")
    with common.scratch():
        assert sorted(r["_ndrow"] for r in neardup._only(some, common.staged(wanted, "rows")).collect()) == rows
