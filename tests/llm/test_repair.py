import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import oracles, repair

ROWS = "conv_id long, turn long, role string, text string"
WORD = re.compile("[^\x20\x09-\x0D]")


def brute(rows):
    """All edit scripts of a few rows (role, text), straight from the rules: counts, cost, audit, repaired text."""
    faults, seen = [], set()
    for role, text in rows:
        marks = WORD.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    options = []
    for (role, text), fault in zip(rows, faults):
        own = [("D", 3, [])]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            own += [("K", more, [(role, text)])] + [("R", 2 + more, [(to, text)]) for to in ("user", "assistant")]
        options.append(own)
    extra = [("I" * n, 2 * n, [(r, "") for r in roles]) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    slots = [extra]
    for own in options:
        slots += [own, extra]
    for script in itertools.product(*slots):
        cost = sum(x[1] for x in script)
        if best is not None and cost > best[0]:
            continue
        out = [r for x in script for r in x[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and all(r for r, _ in out):
            audit = "".join(x[0] for x in script)
            if best is None or (cost, audit) < best[:2]:
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1],
            hashlib.sha256(best[2].encode()).hexdigest())


def gaps(turns):
    some = {t for t in turns if t is not None}
    return max(some) - min(some) + 1 - len(some) if some else 0


def plain(rows):
    """Results of conversations, rows as (conv_id, turn, role, text, copies)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv for _ in range(r[4])]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        out[conv] = (gaps([r[1] for r in own]), *brute([(r[2], r[3]) for r in own]))
    return out


def programme(symbols):
    """The same cheapest edits for longer sequences, with plain strings and one matrix for each row."""
    best = {0: (0, "")}
    moves = [(i, i, 0, "") for i in range(4)] + [(0, 2, 2, "I"), (0, 3, 4, "II"), (1, 2, 2, "I"), (1, 3, 4, "II"), (2, 3, 2, "I"), (3, 2, 2, "I")]
    for symbol in symbols:
        nxt = {}
        for i, k, c, a in moves:
            if i not in best:
                continue
            t = symbol.isupper()
            own = [(k, 3, "D")]
            if symbol != "x":
                own.append(({0: 2, 1: 2, 2: 3, 3: 2}[k], 2 + t, "R"))
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(symbol.lower(), {}).get(k)
                own += [(to, t, "K")] if to else []
            for j, c2, a2 in own:
                e = (best[i][0] + c + c2, best[i][1] + a + a2)
                nxt[j] = min(nxt.get(j, e), e)
        best = nxt
    return min((best[i][0] + c, best[i][1] + a) for i, k, c, a in moves if i in best and k in (0, 3) and (k == 3 or i == 0))


def random_rows(rnd, n):
    texts = ["Hi.", "Well", "", " \t", "Yes!", "a\x85", "…", "why? ", "no"]
    roles = ["user", "assistant", "system", "tool", "", "unknown", "Admin"]
    return [(rnd.choice(roles[:3] if rnd.random() < 0.8 else roles), rnd.choice(texts) if rnd.random() < 0.6 else f"text {rnd.random()}.") for _ in range(n)]


def test_edits_equal_all_scripts():
    rnd = random.Random(7)
    for _ in range(60):
        rows, seen, symbols = random_rows(rnd, rnd.randint(0, 4)), set(), ""
        for r in rows:
            symbols += repair.symbol_of(*r, r in seen)
            seen.add(r)
        blank, duplicate, truncated, illegal, cost, audit, digest = brute(rows)
        assert repair.solve([symbols])[symbols] == (cost, audit)
        text = "\n".join(repair.edited([(*r, 1) for r in rows], audit, repair.START)[0])
        assert hashlib.sha256(text.encode()).hexdigest() == digest


def test_grammar_equals_a_plain_programme():
    rnd = random.Random(8)
    sequences = ["".join(rnd.choice("suaoSUAOxua") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    sequences += ["ua" * 500, "x" * 333, "s" + "uU" * 100, "", "a" * 97]
    found = repair.solve(sequences)
    for s in sequences:
        assert found[s] == programme(s), s


def test_grammar_restores_its_sequences_and_shares_rules():
    rnd = random.Random(9)
    sequences = ["".join(rnd.choice("uaxU") for _ in range(rnd.randint(0, 40))) for _ in range(200)] + ["x" * 50, "xxx"]
    rules, short = repair.re_pair([list(s) for s in sequences])

    def spelled(x):
        return x if isinstance(x, str) else spelled(rules[x][0]) + spelled(rules[x][1])

    assert ["".join(map(spelled, s)) for s in short] == sequences
    assert sum(map(len, short)) < 0.5 * sum(map(len, sequences))
    pairs = [p for s in short for p in zip(s, s[1:])]
    assert len(pairs) - len(set(pairs)) <= 2  # only overlapping places of a pair may be left


def test_ropes_compare_as_strings():
    rnd = random.Random(10)
    def rope(s):
        if len(s) < 3:
            return repair.Rope(s)
        k = rnd.randint(1, len(s) - 1)
        return rope(s[:k]) + rope(s[k:])
    for _ in range(500):
        a = "".join(rnd.choice("DK") for _ in range(rnd.randint(1, 30)))
        b = a[:rnd.randint(0, len(a))] + "".join(rnd.choice("DIKR") for _ in range(rnd.randint(0, 9)))
        x, y = rope(a), rope(b) if b else repair.Rope("")
        assert (x < y, y < x, str(x), str(x + y)) == (a < b, b < a, a, a + b)


@pytest.mark.parametrize("size", [1 << 20, 1])
def test_conversations_equal_all_scripts(spark, monkeypatch, size):
    """Null ids, turns, roles and texts, ties, repeated rows, rows that are dropped; chunks of all rows or of one."""
    monkeypatch.setattr(repair, "CHUNK_TEXT", size)
    rnd, rows = random.Random(11), []
    for conv in [None, *range(40)]:
        for role, text in random_rows(rnd, rnd.randint(1, 4)):
            rows.append((conv, rnd.choice([None, 0, 1, 2, 5, -(1 << 40)]), role, text, rnd.choice([1, 1, 1, 0])))
    rows += [(90, 1, "user", "Same.", 1)] * 3 + [(91, 1, "user", "x", 0)] + [(92, None, "user", "Only null.", 1)]
    frame = spark.createDataFrame([(*r, 1.5) for r in rows], ROWS + ", copies int, state double").repartition(3)
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(frame).collect()}
    assert found == plain(rows)


def test_a_conversation_of_many_rows_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 100)
    rnd = random.Random(12)
    rows = [(1, i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "So", f"Text {i}."])) for i in range(3000)]
    rows += [(c, i, "user", f"{c} {i}.") for c in (0, 2) for i in range(3)]
    found = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, ROWS)).collect()}
    symbols, seen = "", set()
    for _, _, role, text in rows[:3000]:
        symbols += repair.symbol_of(role, text, (role, text) in seen)
        seen.add((role, text))
    cost, audit = programme(symbols)
    lines, _ = repair.edited([(r[2], r[3], 1) for r in rows[:3000]], audit, repair.START)
    assert (found[1]["cost"], found[1]["audit"]) == (cost, audit)
    assert found[1]["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert found[1]["gaps"] == 0 and found[1]["duplicate"] == symbols.count("x")
    assert len(found) == 3 and found[0]["audit"] == found[2]["audit"] == "KIKR"


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", "One. Two! Three? four.") for c in range(30) for t in range(8)] + [(None, None, None, None), (5, None, "user", None)]
    frame = spark.createDataFrame(rows, ROWS)
    got = sorted(map(tuple, repair.damaged(frame).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want.append((c, t, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)))
    assert got == sorted(want, key=str)
    assert repair.repaired_conversations(frame.where("false")).count() == 0
    assert repair.repaired_conversations(frame).select("conv_id").distinct().count() == 31


def test_the_sql_says_the_same(spark, tmp_path):
    rnd, rows = random.Random(13), []
    for conv in [None, *range(60)]:
        for role, text in random_rows(rnd, rnd.randint(1, 9)):
            rows.append((conv, rnd.choice([None, 0, 1, 2, 5, 7]), None if rnd.random() < 0.1 else role, None if rnd.random() < 0.1 else text))
    frame = spark.createDataFrame(rows, ROWS).repartition(3)
    frame.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = con.execute(oracles.REPAIR).fetchall()
    found = repair.repaired_conversations(frame).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want)) and len(found) == 61
