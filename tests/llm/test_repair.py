"""Conversation repair against a plain recurrence over (cost, audit), and against all short edit sequences."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from leadmill.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, conv string, n long"
GOOD = re.compile(r"(s?(ua)+)?")


def damage(rows):
    for c, t, role, text in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        yield from [(c, t, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)


def faults(rows):
    seen = set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        yield "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))


def cheapest(rows):
    """The least (cost, audit, turns) of rows (role, text, fault)."""
    due = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    @cache
    def least(i, last):
        ends = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        found = list(ends)
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, turns = least(i + 1, last)
            found.append((cost + 2, "D" + audit, turns))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                cost, audit, turns = least(i + 1, due[last][0])
                found.append((cost + 1 + more, "R" + audit, ((due[last], text), *turns)))
                if role[:1] == due[last][0] or (last == "" and role[:1] == "s"):
                    cost, audit, turns = least(i + 1, role[0])
                    found.append((cost + more, "K" + audit, ((role, text), *turns)))
        # up to two inserts; a third would only repeat the first
        for n in (1, 2):
            at, put = last, []
            for _ in range(n):
                put.append((due[at], ""))
                at = due[at][0]
            if not (i < len(rows) or at == "a"):
                continue
            for cost, audit, turns in moves(i, at):
                found.append((cost + 5 * n, "I" * n + audit, (*put, *turns)))
        return min(found)

    def moves(i, last):
        if i == len(rows):
            return [(0, "", ())] if last in ("", "a") else []
        role, text, fault = rows[i]
        cost, audit, turns = least(i + 1, last)
        out = [(cost + 2, "D" + audit, turns)]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            cost, audit, turns = least(i + 1, due[last][0])
            out.append((cost + 1 + more, "R" + audit, ((due[last], text), *turns)))
            if role[:1] == due[last][0] or (last == "" and role[:1] == "s"):
                cost, audit, turns = least(i + 1, role[0])
                out.append((cost + more, "K" + audit, ((role, text), *turns)))
        return out

    return least(0, "")


def brute(rows):
    held = {c: [] for c, *_ in rows}
    for c, t, role, text in damage(rows):
        held[c].append((t is not None, t or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    for c, mine in held.items():
        mine.sort()
        told = [(r[2], r[4]) for r in mine]
        found = list(faults(told))
        turns = {r[1] for r in mine if r[0]}
        cost, audit, fixed = cheapest([(*x, f) for x, f in zip(told, found, strict=True)])
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        gaps = min(max(turns) - min(turns) + 1 - len(turns), repair.MOST) if turns else 0
        yield (str(c), gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())


def ours(spark, rows):
    df = repair.repair(spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA))
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def some(n, seed):
    r = random.Random(seed)
    for c in range(n):
        turn = 0
        for _ in range(r.choice([1, 2, 3, 5, 8, 13])):
            turn += r.choice([0, 1, 1, 1, 2, 4])
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "u"])
            text = r.choice([None, "", " \t", "Hello there.", "Hello there.", "no end", "Why?", "a\nb!\n", "x" * 3000, "ü é. ", " "])
            yield c if c else None, r.choice([turn, turn, turn, None]), role, text


def test_repair_equals_the_plain_recurrence(spark):
    rows = list(some(250, 3))
    rows += rows[:60]
    assert ours(spark, rows) == sorted(brute(rows))


def test_long_and_hot_conversations(spark):
    r = random.Random(9)
    rows = [(1, t, r.choice(["user", "assistant"]), f"line {t}.") for t in range(400)]
    rows += [(2, t, "user", "the same.") for t in range(300)] + [(3, 5, "user", f"tie {t}.") for t in range(200)] + [(4, 7, "assistant", "one and the same row.")] * 300
    rows += [(5, 2**63 - 1, "user", "a."), (5, -(2**63), "assistant", "b."), (6, None, "user", "a."), (6, None, "assistant", "b.")]
    assert ours(spark, rows) == sorted(brute(rows))


def test_empty_table_and_dropped_rows(spark):
    assert ours(spark, []) == []
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert ours(spark, [(gone, 0, "user", "a.")]) == [(str(gone), 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_least_edits_of_all_sequences():
    """Every edit sequence of up to three rows with up to three inserts."""
    table = repair.Symbols()
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    def sequences(symbols, last="", inserted=0):
        if not symbols and last in ("", "a"):
            yield 0, ""
        if inserted < 3:
            for c, a in sequences(symbols, due[last], inserted + 1):
                yield c + 5, "I" + a
        if symbols:
            (initial, fault), rest = symbols[0], symbols[1:]
            for c, a in sequences(rest, last, inserted):
                yield c + 2, "D" + a
            if fault in "03":
                more = 5 if fault == "3" else 0
                for c, a in sequences(rest, due[last], inserted):
                    yield c + 1 + more, "R" + a
                if initial == due[last] or (initial == "s" and last == ""):
                    for c, a in sequences(rest, initial, inserted):
                        yield c + more, "K" + a

    kinds = [i + f for i in "sua-" for f in "013"]
    for n in range(4):
        for symbols in itertools.product(kinds, repeat=n):
            runs = repair.Runs("x")
            for s in symbols:
                runs.add(s, 1)
            assert table.edits(runs.names, runs.lengths) == min(sequences(symbols)), symbols


def test_runs_longer_than_a_block():
    table = repair.Symbols()
    for symbol in ("u0", "a0", "u1", "s0", "-3"):
        for n in (1023, 1024, 1025, 3000):
            runs = repair.Runs("x")
            runs.add(symbol, n)
            cost, audit = table.edits(runs.names, runs.lengths)
            split = repair.Symbols()
            assert len(audit) - audit.count("I") == n
            assert cost == split.before(symbol, n, split.last)[0]
            assert cost == sum({"D": 2, "K": 0, "R": 1, "I": 5}[x] + (5 if symbol[1] == "3" and x in "KR" else 0) for x in audit)


def test_repaired_turns_are_the_digest(spark):
    rows = spark.createDataFrame([(*r, "x", "y", 7) for r in some(40, 11)], SCHEMA).select("conv_id", "turn", "role", "text")
    found, _ = repair.audit(rows)
    fixed = repair.repaired_turns(rows, found).collect()
    whole = repair.digests(rows, found).collect()
    for r in whole:
        mine = [x for x in sorted(fixed, key=lambda x: x["place"]) if x["conv"] == r["conv"]]
        assert GOOD.fullmatch("".join(x["role"][0] for x in mine))
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in mine).encode()).hexdigest() == r["repaired_sha256"]
    assert spark.createDataFrame(fixed).groupBy("conv", "place").count().where(F.col("count") > 1).count() == 0


@pytest.fixture(autouse=True)
def _partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
