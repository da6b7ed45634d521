"""Conversation structure repair: the cheapest edits after which a conversation is an
optional system turn and then pairs of user and assistant.

A row counts by its symbol alone: its role's initial and its first fault. Equal
consecutive symbols are one run. A symbol is a min-plus transition between four
states (nothing yet, after system, after user, after assistant), a run is a power of
it, and binary powers are kept per symbol, so a run's cost takes steps of the
logarithm of its length. The audit then walks the runs from the front and takes the
ASCII-least edit that still reaches the least cost.

What moves: rows as digests of their text go to the tasks once to find duplicates
(copies are counted before they move) and once more in order, dealt by ranges of
conversation, turn and role, so that a conversation with a large share of all rows is
spread over tasks; each task hands on runs. Runs (a letter or less for each row, as the
audit itself) meet per conversation. Texts move once: they pass a task in order and
only a hash state is kept. One SHA-256 over a whole conversation is sequential by its
nature, so its bytes pass one task, in bounded memory.

Defined results: nulls of role and text, and of id and turn in the key of the damage,
are one space; rows of one turn are ordered by role, then by the SHA-256 of the text;
all rows with a null id are one conversation; a role that begins with none of s, u, a is
never kept as it is; gaps beyond a long stay at its greatest value; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import discard, materialise

MOST = (1 << 63) - 1
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
DELETE, KEEP, REROLE, INSERT, TRUNCATED = 2, 0, 1, 5, 5
#: A cost that no conversation reaches.
NEVER = 1 << 60
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Runs, and rows of a run, whose costs are held at a time.
BLOCK = 1024

Matrix = tuple[tuple[int, ...], ...]


def then(state: int) -> int:
    """The state after a turn of the role that is due."""
    return ASSISTANT if state == USER else USER


def kept_to(state: int, initial: str) -> int | None:
    """The state after a turn with this initial, where it may stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    return then(state) if initial == ("a" if state == USER else "u") else None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(min(x + y for x, y in zip(row, v, strict=True)), NEVER) for row in a)


def inserts() -> Matrix:
    """The least cost of turns inserted between two states; three reach all that more can."""
    rows = []
    for state in range(4):
        row, at = [NEVER] * 4, state
        for n in range(4):
            row[at] = min(row[at], n * INSERT)
            at = then(at)
        rows.append(tuple(row))
    return tuple(rows)


class Symbols:
    """Transitions by symbol, inserts before the row included, and their binary powers."""

    def __init__(self) -> None:
        self.free = inserts()
        self.powers: dict[str, list[Matrix]] = {}
        self.last = applied(self.free, tuple(0 if s in ENDS else NEVER for s in range(4)))

    def row(self, symbol: str) -> Matrix:
        """A row's own edits: delete it, keep it or give it the role that is due."""
        initial, fault = symbol[0], int(symbol[1])
        rows = []
        for state in range(4):
            row = [NEVER] * 4
            row[state] = DELETE
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                row[then(state)] = min(row[then(state)], REROLE + more)
                if (to := kept_to(state, initial)) is not None:
                    row[to] = min(row[to], KEEP + more)
            rows.append(tuple(row))
        return tuple(rows)

    def power(self, symbol: str, k: int) -> Matrix:
        """The transition of 2 ** k such rows."""
        kept = self.powers.setdefault(symbol, [times(self.free, self.row(symbol))])
        while len(kept) <= k:
            kept.append(times(kept[-1], kept[-1]))
        return kept[k]

    def before(self, symbol: str, length: int, after: tuple[int, ...]) -> tuple[int, ...]:
        """Costs to go before a run, from those after it."""
        k = 0
        while length:
            if length & 1:
                after = applied(self.power(symbol, k), after)
            length, k = length >> 1, k + 1
        return after

    def edits(self, names: list[str], lengths: array) -> tuple[int, str]:
        """The least cost of runs and the ASCII-least audit of it. Costs to go are kept
        at every BLOCK-th run and worked out again between, which bounds memory."""
        marks = [self.last]
        for low in reversed(range(0, len(lengths), BLOCK)):
            marks.append(self.ahead(names, lengths, low, marks[-1])[0])
        cost, audit, state = marks.pop()[START], [], START
        for low in range(0, len(lengths), BLOCK):
            costs = self.ahead(names, lengths, low, marks.pop())
            for k, after in enumerate(costs[1:], low):
                state = self.unroll(names[k], lengths[k], after, state, audit)
        while self.last[state]:
            audit.append("I")
            state = then(state)
        return cost, "".join(audit)

    def ahead(self, names: list[str], lengths: array, low: int, after: tuple[int, ...]) -> list[tuple[int, ...]]:
        """Costs to go before each run of a block and behind its last."""
        costs = [after]
        for k in reversed(range(low, min(low + BLOCK, len(lengths)))):
            costs.append(self.before(names[k], lengths[k], costs[-1]))
        return costs[::-1]

    def unroll(self, symbol: str, length: int, after: tuple[int, ...], state: int, audit: list[str]) -> int:
        """Append the edits of a run that starts in `state`, BLOCK rows at a time; the state behind it."""
        one, fault = self.power(symbol, 0), int(symbol[1])
        free, more = fault not in (BLANK, DUPLICATE), TRUNCATED if fault == CUT else 0
        to = [kept_to(s, symbol[0]) for s in range(4)]
        while length:
            some = min(length, BLOCK)
            length -= some
            costs = [self.before(symbol, length, after)]
            for _ in range(some):
                costs.append(applied(one, costs[-1]))
            costs.reverse()
            told = []
            for here, rest in zip(costs, costs[1:], strict=False):
                while DELETE + rest[state] != here[state] and INSERT + here[then(state)] == here[state]:
                    told.append("I")
                    state = then(state)
                if DELETE + rest[state] == here[state]:
                    told.append("D")
                elif free and to[state] is not None and KEEP + more + rest[to[state]] == here[state]:
                    told.append("K")
                    state = to[state]
                else:
                    told.append("R")
                    state = then(state)
            audit.append("".join(told))
        return state


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the number of copies of each row after the damage."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20).cast("int")
    text = F.when(F.col("what") == 1, F.lit("")).when(F.col("what") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(F.col("what") == 4, F.lit("user")).otherwise(spaced("role"))
    return rows.withColumn("what", what).where("what <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("what") == 3, 2).otherwise(1).cast("long").alias("copies"))


def own_fault(text: Column) -> Column:
    bare = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(CUT)


def turns(rows: DataFrame) -> DataFrame:
    """Rows after the damage, equal ones of a turn once with their number n; texts are digests here."""
    initial = F.substring("role", 1, 1)
    told = damaged(rows).select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), own_fault(F.col("text")).alias("fault"), "copies")
    return told.groupBy("conv_id", "turn", "role", "digest").agg(F.first("initial").alias("initial"), F.first("fault").alias("fault"), F.sum("copies").alias("n"))


def led(seen: DataFrame) -> DataFrame:
    """turns() with `leads`: whether the row is the first of its role and text in the conversation."""
    place = lambda turn: F.struct(turn.isNotNull().alias("told"), F.coalesce(turn.cast("long"), F.lit(0)).alias("turn"))
    first = seen.groupBy("conv_id", "role", "digest").agg(F.min(place(F.col("turn"))).alias("least"))
    a, b = seen.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    return a.join(b, same).select("a.*", (place(F.col("a.turn")) == F.col("b.least")).alias("leads"))


def partitions(df: DataFrame) -> int:
    """As many as shuffles have: rows are few bytes here and much work, so tasks are not to be joined by bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def listed(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def batch_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))


def in_runs(rows: DataFrame, tasks: int) -> DataFrame:
    """Each conversation's rows in order as runs of (initial, fault): conv, part, place, symbol, length.
    Runs break where a task's range ends."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # copies within a turn follow the row itself; a blank one stays blank
    lead = F.when(F.col("leads") | (F.col("fault") == BLANK), F.col("fault")).otherwise(DUPLICATE)
    rest = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    told = dealt.select(F.col("conv_id").cast("string"), F.spark_partition_id(), F.concat("initial", lead.cast("string")), F.concat("initial", rest.cast("string")), "n")
    kinds = {"conv": pa.string(), "part": pa.int32(), "place": pa.int64(), "symbol": pa.string(), "length": pa.int64()}

    def collapse(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, place = None, 0
        for batch in found:
            out = []
            for conv, part, one, more, n in listed(batch):
                for symbol, length in ((one, 1), (more, n - 1)):
                    if length and run and run[0] == conv and run[3] == symbol:
                        run = (*run[:4], run[4] + length)
                    elif length:
                        out += [run] if run else []
                        run, place = (conv, part, place, symbol, length), place + 1
            yield batch_of(out, kinds)
        yield batch_of([run] if run else [], kinds)

    return told.mapInArrow(collapse, "conv string, part int, place long, symbol string, length long")


class Runs:
    """A conversation's runs in order, neighbours of one symbol joined."""

    def __init__(self, conv: str | None):
        self.conv, self.names, self.lengths = conv, [], array("q")

    def add(self, symbol: str, length: int) -> None:
        if self.names and self.names[-1] == symbol:
            self.lengths[-1] += length
        else:
            self.names.append(sys.intern(symbol))
            self.lengths.append(length)

    def told(self, table: Symbols) -> tuple:
        count = [0] * 4
        for s, n in zip(self.names, self.lengths, strict=True):
            count[int(s[1])] += n
        illegal = sum(self.lengths) - len(self.lengths) + sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairwise(self.names))
        return (self.conv, count[BLANK], count[DUPLICATE], count[CUT], illegal, *table.edits(self.names, self.lengths))


def decide(runs: DataFrame) -> DataFrame:
    """conv, the number of each fault, illegal neighbours, cost and audit."""
    dealt = runs.repartition(partitions(runs), F.col("conv")).sortWithinPartitions("conv", "part", "place").select("conv", "symbol", "length")
    kinds = {"conv": pa.string(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string()}

    def each(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = Symbols(), None
        for batch in found:
            out = []
            for conv, symbol, length in listed(batch):
                if held is None or held.conv != conv:
                    out += [held.told(table)] if held else []
                    held = Runs(conv)
                held.add(symbol, length)
            yield batch_of(out, kinds)
        yield batch_of([held.told(table)] if held else [], kinds)

    return dealt.mapInArrow(each, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def walked(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one task: conv, audit, role, text and copies.

    The audit comes first as its row's `told` is -1."""
    told = F.when(F.col("turn").isNull(), 0).otherwise(1)
    texts = damaged(rows).select(F.col("conv_id").cast("string").alias("conv"), told.alias("told"), F.col("turn").cast("long").alias("turn"), "role", F.sha2("text", 256).alias("digest"), "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv", F.lit(-1).alias("told"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    both = texts.unionByName(heads)
    both = both.repartition(partitions(both), F.col("conv"))
    return both.sortWithinPartitions("conv", "told", "turn", "role", "digest").select("conv", "told", "role", "text", "copies", "audit")


class Walk:
    """Follows an audit over the rows of a conversation and yields the repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def due(self) -> str:
        role = "assistant" if self.state == USER else "user"
        self.state = then(self.state)
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.due(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = kept_to(self.state, role[0])
            yield role, text
        elif edit == "R":
            yield self.due(), text


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, place, role and text of the repaired conversations."""
    kinds = {"conv": pa.string(), "place": pa.int64(), "role": pa.string(), "text": pa.string()}

    def each(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv, place = Walk(""), None, 0
        for batch in found:
            out = []
            for c, told, role, text, copies, audit in listed(batch):
                turns = walk.inserted() if told < 0 else chain.from_iterable(walk.row(role, text) for _ in range(copies))
                for turn in turns:
                    out.append((conv, place, *turn))
                    place += 1
                if told < 0:
                    walk, conv, place = Walk(audit), c, 0
            yield batch_of(out, kinds)
        yield batch_of([(conv, place + k, *turn) for k, turn in enumerate(walk.inserted())], kinds)

    return walked(rows, audits).mapInArrow(each, "conv string, place long, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its repaired turns as `role:text`, joined by line feeds."""
    kinds = {"conv": pa.string(), "repaired_sha256": pa.string()}

    def each(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv, state, between, begun = Walk(""), None, hashlib.sha256(), "", False
        for batch in found:
            out = []
            for c, told, role, text, copies, audit in listed(batch):
                turns = walk.inserted() if told < 0 else chain.from_iterable(walk.row(role, text) for _ in range(copies))
                for turn in turns:
                    state.update(f"{between}{turn[0]}:{turn[1]}".encode())
                    between = "\n"
                if told < 0:
                    out += [(conv, state.hexdigest())] if begun else []
                    walk, conv, state, between, begun = Walk(audit), c, hashlib.sha256(), "", True
            yield batch_of(out, kinds)
        for turn in walk.inserted():
            state.update(f"{between}{turn[0]}:{turn[1]}".encode())
            between = "\n"
        yield batch_of([(conv, state.hexdigest())] if begun else [], kinds)

    return walked(rows, audits).mapInArrow(each, "conv string, repaired_sha256 string")


def gaps(seen: DataFrame) -> DataFrame:
    """conv_id and the turns missing between its first and last."""
    wide = lambda c: c.cast("decimal(38,0)")
    found = seen.select("conv_id", "turn").distinct().groupBy("conv_id").agg((wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count("turn"))).alias("gaps"))
    return found.select(F.col("conv_id").cast("string").alias("conv"), F.least(F.coalesce("gaps", wide(F.lit(0))), wide(F.lit(MOST))).cast("long").alias("gaps"))


def audit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, faults, illegal, cost, audit) and (conv, gaps), both as written tables."""
    spark = rows.sparkSession
    seen = materialise(turns(rows), "turns")
    told = materialise(led(seen), "led")
    found = materialise(decide(in_runs(told, partitions(told))), "audits")
    missing = materialise(gaps(seen), "gaps")
    discard(spark, seen, told)
    return found, missing


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text): its gaps, faults, illegal
    neighbours, cost, audit and the digest of the repaired turns. repaired_turns() has the turns themselves."""
    rows = rows.select("conv_id", "turn", "role", "text")
    found, missing = audit(rows)
    every = rows.select("conv_id").distinct().withColumn("conv", F.col("conv_id").cast("string"))
    joined = every
    for other in (missing, found, digests(rows, found)):
        own = [F.col(f"o.{c}") for c in other.columns if c != "conv"]
        joined = joined.alias("e").join(other.alias("o"), F.col("e.conv").eqNullSafe(F.col("o.conv")), "left").select("e.*", *own)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
