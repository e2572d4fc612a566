"""Repair of conversation structure by Knuth's lightest-derivation agenda.

Items (position, state) say that the rows up to a position have been repaired into role initials that lead the grammar
`(s?(ua)+)?` into a state. A rule appends one edit to an item, or an insertion; its value is the pair (cost, audit), compared in
this order. Appending never makes a value smaller, and of two values of an item it keeps the order: at equal cost neither audit is a
prefix of the other, since the audit of given rows fixes their cost. So the functions are superior and monotone, the
agenda pops every item once, with its lightest derivation, and ends when a goal item is popped.

A derivation depends on the rows' symbols only (role initial, whether truncated, whether it must go), so each task keeps the
derivations of the shapes it has seen. Conversations of up to SEGMENT_ROWS rows are dealt by key and repaired in one piece.
Longer ones are sorted by ranges over all tasks and cut into segments. A segment's lightest derivations from every state to
every state are themselves rules, (position, state) to (position + 1, state'); the same agenda combines up to FAN of them,
level by level, until one row per conversation is left, and the states on its path are handed down again. So no task
holds more than a segment, or FAN rows of the level below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxloom.llm.common import query, table
from rxloom.session import materialise

#: States of the grammar: nothing yet, after the system row, after a user row, after an assistant row; the first and last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
GOALS = (START, ASSISTANT)
#: The one role that a row may be rerolled to, or be inserted with, in each state.
WANTED = ("user", "user", "assistant", "user")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: Rows and bytes of text that one piece may have (a single row may have more).
SEGMENT_ROWS = 256
SEGMENT_BYTES = 4 << 20
#: Pieces combined at once.
FAN = 64
#: Conversations whose pieces are returned in one batch.
OUT = 1000

SPACES = " \t\n\v\f\r"
ENDS = frozenset(".!?")
LEGAL = frozenset(("su", "ua", "au"))

TURNS = "array<struct<role: string, text: string>>"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
#: What is known of a piece besides its derivations; pieces side by side are added up by `joined`.
FACTS = ["low", "high", "distinct", "first_turn", "last_turn", "first_role", "last_role", *COUNTS]
FACT_SCHEMA = "low long, high long, distinct long, first_turn long, last_turn long, first_role string, last_role string, " + ", ".join(f"{c} long" for c in COUNTS)


def lightest(steps: list[dict[int, list[tuple[int, int, str]]]], start: int, inserts: bool, goals: tuple[int, ...] | None = None) -> dict:
    """Values {(position, state): (cost, audit, item before)} of the items popped, until a goal at the end is; all without goals.

    steps: for each position and state the rules (state after, cost, letters). inserts: whether rows may be inserted.
    """
    done: dict[tuple[int, int], tuple[int, str, tuple[int, int] | None]] = {}
    agenda: list = [(0, "", 0, start, None)]
    n = len(steps)
    while agenda:
        cost, audit, at, state, before = heappop(agenda)
        item = (at, state)
        if item in done:
            continue
        done[item] = (cost, audit, before)
        if at == n and goals is not None and state in goals:
            break
        if inserts:
            to = NEXT[state, WANTED[state][0]]
            if (at, to) not in done:
                heappush(agenda, (cost + INSERT, audit + "I", at, to, item))
        if at < n:
            for to, price, letters in steps[at].get(state, ()):
                if (at + 1, to) not in done:
                    heappush(agenda, (cost + price, audit + letters, at + 1, to, item))
    return done


@lru_cache(maxsize=None)
def row_rules(symbol: str) -> dict[int, list[tuple[int, int, str]]]:
    """Rules of one row by state. `d` must be deleted; else the role's initial or `x`, upper case where truncated."""
    rules = {}
    for state in range(4):
        found = [(state, DELETE, "D")]
        if symbol != "d":
            more = TRUNCATED * symbol.isupper()
            if (state, symbol.lower()) in NEXT:
                found.append((NEXT[state, symbol.lower()], KEEP + more, "K"))
            found.append((NEXT[state, WANTED[state][0]], REROLE + more, "R"))
        rules[state] = found
    return rules


@lru_cache(maxsize=20_000)
def repair_shape(shape: str) -> tuple[int, str]:
    """The lightest (cost, audit) of rows with these symbols."""
    done = lightest([row_rules(x) for x in shape], START, True, GOALS)
    return min(done[len(shape), g][:2] for g in GOALS if (len(shape), g) in done)


@lru_cache(maxsize=2_000)
def shape_between(shape: str, start: int) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) from a state to each state that rows with these symbols can lead to."""
    done = lightest([row_rules(x) for x in shape], start, True)
    return {s: done[at, s][:2] for at, s in done if at == len(shape)}


def symbol_of(role: str, text: str, seen: bool) -> tuple[str, int]:
    """A row's symbol and its first fault: 0 blank, 1 duplicate, 2 truncated, 3 none."""
    body = text.rstrip(SPACES)
    if not body:
        return "d", 0
    if seen:
        return "d", 1
    first = role[:1]
    symbol = first if first and first in "sua" else "x"
    return (symbol, 3) if body[-1] in ENDS else (symbol.upper(), 2)


def edited(audit: str, state: int, roles: list[str], bodies: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of an audit that begins in `state`."""
    if audit.count("K") == len(audit):
        return roles, bodies
    new_roles, new_bodies, i = [], [], 0
    for x in audit:
        if x != "D":
            role = roles[i] if x == "K" else WANTED[state]
            new_roles.append(role)
            new_bodies.append("" if x == "I" else bodies[i])
            state = NEXT[state, role[0]]
        i += x != "I"
    return new_roles, new_bodies


class Piece(NamedTuple):
    """Consecutive rows of one conversation: facts in the order of FACTS, one symbol per row."""

    facts: tuple
    shape: str


def piece_of(turns: list, roles: list[str], bodies: list[str], dup: list[bool] | None = None) -> Piece:
    """dup: whether a row was seen before; found among the rows themselves where it is not given."""
    counts = [0, 0, 0, 0]
    shape, seen = [], set()
    for i, (role, body) in enumerate(zip(roles, bodies, strict=True)):
        if dup is None:
            before = len(seen)
            seen.add((role, body))
            again = len(seen) == before
        else:
            again = dup[i]
        symbol, fault = symbol_of(role, body, again)
        shape.append(symbol)
        counts[fault] += 1
    firsts = [r[:1] for r in roles]
    illegal = sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:], strict=False))
    known = [t for t in turns if t is not None]
    facts = (known[0] if known else None, known[-1] if known else None, len(set(known)), turns[0], turns[-1], firsts[0], firsts[-1], *counts[:3], illegal)
    return Piece(facts, "".join(shape))


def joined(parts: list[tuple]) -> tuple:
    """Facts of pieces that follow one another."""
    low = next((p[0] for p in parts if p[0] is not None), None)
    high = next((p[1] for p in reversed(parts) if p[1] is not None), None)
    pairs = list(zip(parts, parts[1:], strict=False))
    distinct = sum(p[2] for p in parts) - sum(a[4] is not None and a[4] == b[3] for a, b in pairs)
    counts = [sum(p[k] for p in parts) for k in range(7, 11)]
    counts[3] += sum(a[6] + b[5] not in LEGAL for a, b in pairs)
    return (low, high, distinct, parts[0][3], parts[-1][4], parts[0][5], parts[-1][6], *counts)


def gaps(facts: tuple) -> int:
    return 0 if facts[0] is None else facts[1] - facts[0] + 1 - facts[2]


def sliced(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Runs of equal keys (first column) in ordered batches, cut after `rows` rows or `size` bytes of text (column x).

    With each the flags whether it is a key's first and last.
    """
    held: pa.Table | None = None
    fresh = True

    def cut(t: pa.Table, end: bool) -> Iterator[tuple[pa.Table, bool, bool]]:
        nonlocal held, fresh
        codes = t.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        used = np.cumsum(pc.fill_null(pc.binary_length(t.column("x")), 0).to_numpy().astype(np.int64))
        stops = [*(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        at = 0
        for stop in stops:
            while at < stop:
                base = used[at - 1] if at else 0
                to = min(stop, at + rows, max(at + 1, int(np.searchsorted(used, base + size, side="right"))))
                if to == len(codes) and not end:
                    held = t.slice(at)
                    return
                yield t.slice(at, to - at), fresh, to == stop
                fresh = to == stop
                at = to
        held = None

    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        yield from cut(now if held is None else pa.concat_tables([held, now]).combine_chunks(), False)
    if held is not None:
        yield from cut(held, True)


def turns_array(found: list[tuple[list[str], list[str]]]) -> pa.Array:
    offsets = np.cumsum([0, *(len(r) for r, _ in found)]).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array([x for r, _ in found for x in r], pa.string()), pa.array([x for _, b in found for x in b], pa.string())], ["role", "text"])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def ordered_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The columns k, t, r, x of an input; null roles and texts are one space."""
    return df.select(F.col(conv).alias("k"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role), F.lit(" ")).alias("r"),
                     F.coalesce(F.col(text), F.lit(" ")).alias("x"))


def row_order() -> list[Column]:
    return [F.asc_nulls_first("t"), F.col("r"), F.sha2(F.col("x"), 256)]


def repair_whole(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size, each repaired at once from rows dealt by key."""
    kind = rows.schema["k"].dataType
    schema = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns " + TURNS).fields])
    ordered = rows.repartition("k").sortWithinPartitions("k", *row_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, audits, found, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            made = np.array(numbers, np.int64).reshape(-1, 6)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *[pa.array(made[:, i]) for i in range(6)], pa.array(audits, pa.string()), turns_array(found)],
                                              ["conv", "gaps", *COUNTS, "cost", "audit", "turns"])

        for part, _, _ in sliced(batches, 1 << 30, 1 << 40):
            roles, bodies = part.column("r").to_pylist(), part.column("x").to_pylist()
            piece = piece_of(part.column("t").to_pylist(), roles, bodies)
            cost, audit = repair_shape(piece.shape)
            keys.append(part.column("k").slice(0, 1).combine_chunks())
            numbers.append((gaps(piece.facts), *piece.facts[7:], cost))
            audits.append(audit)
            found.append(edited(audit, START, roles, bodies))
            size += sum(map(len, bodies))
            if len(keys) >= OUT or size >= SEGMENT_BYTES:
                yield out()
                keys, numbers, audits, found, size = [], [], [], [], 0
        if keys:
            yield out()

    return ordered.mapInArrow(run, schema)


def marked(rows: DataFrame) -> DataFrame:
    """`rows` with `dup`: role and text were seen earlier in the conversation.

    Decided on digests: per (conversation, role, text) the first turn. Only what occurs twice is joined back, and
    of equal rows at one turn all but one are copies.
    """
    h = F.sha2(F.col("x"), 256)
    first = rows.groupBy("k", "r", h.alias("h")).agg(F.min(F.struct(F.col("t").isNotNull().alias("known"), "t")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first.select(F.col("k").alias("k2"), F.col("r").alias("r2"), "h", F.col("first.t").alias("t2")), "repeated")
    base = rows.withColumn("hx", h)
    found = base.join(first, base.k.eqNullSafe(first.k2) & (base.r == first.r2) & (base.hx == first.h), "left")
    return found.select("k", "t", "r", "x", F.col("h").isNotNull().alias("twice"), (F.col("h").isNotNull() & ~F.col("t").eqNullSafe(F.col("t2"))).alias("later"))


def segments_of(rows: DataFrame, tasks: int) -> DataFrame:
    """Segments of long conversations: place (part, seg), facts, shape and rows; `part` is the range the rows were sorted into."""
    kind = rows.schema["k"].dataType
    schema = T.StructType([T.StructField("k", kind), *T.StructType.fromDDL(f"part int, seg long, {FACT_SCHEMA}, shape string, turns {TURNS}").fields])
    # All equal rows of one turn go to one range, so that the first of them is known; a turn of many different texts is cut.
    order = ["k", *row_order()]
    ranged = marked(rows).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    fact_types = [f.dataType for f in T.StructType.fromDDL(FACT_SCHEMA).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, last = TaskContext.get().partitionId(), 0, None
        for rows_, fresh, _ in sliced(batches, SEGMENT_ROWS, SEGMENT_BYTES):
            seg = 0 if fresh else seg + 1
            turns, roles, bodies = (rows_.column(c).to_pylist() for c in ("t", "r", "x"))
            dup = []
            for t, r, x, twice, later in zip(turns, roles, bodies, rows_.column("twice").to_pylist(), rows_.column("later").to_pylist(), strict=True):
                now = (t, r, x) if twice else None
                dup.append(later or (now is not None and now == last and not (fresh and not dup)))
                last = now
            piece = piece_of(turns, roles, bodies, dup)
            yield pa.RecordBatch.from_arrays(
                [rows_.column("k").slice(0, 1).combine_chunks(), pa.array([part], pa.int32()), pa.array([seg], pa.int64()),
                 *[pa.array([v], pa.string() if isinstance(f, T.StringType) else pa.int64()) for v, f in zip(piece.facts, fact_types, strict=True)],
                 pa.array([piece.shape]), turns_array([(roles, bodies)])], schema.names)

    return ranged.mapInArrow(run, schema)


def numbered(segments: DataFrame) -> DataFrame:
    """(k, part, seg) with idx, the segment's number in its conversation; the window holds one row per range and conversation."""
    parts = segments.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = parts.selectExpr("k AS k2", "part AS part2", "coalesce(sum(n) OVER (PARTITION BY k ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    return segments.join(before, segments.k.eqNullSafe(before.k2) & (segments.part == before.part2)).withColumn("idx", F.col("base") + F.col("seg")).drop("k2", "part2", "base")


#: A derivation of a piece: from state p to state q at a cost; `path` has the states after each of its parts.
RULE = "array<struct<p: int, q: int, cost: long, audit: string, path: string>>"


def combine(level: DataFrame) -> DataFrame:
    """Rows (k, idx, facts, rules) of which FAN neighbours become one, numbered idx div FAN."""
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["idx"])
        facts = joined([tuple(r[c] for c in FACTS) for r in rows])
        steps: list[dict] = []
        for r in rows:
            rules: dict[int, list] = {}
            for x in r["rules"]:
                rules.setdefault(x["p"], []).append((x["q"], x["cost"], x["audit"]))
            steps.append(rules)
        made = []
        for start in range(4):
            done = lightest(steps, start, False)
            for (at, q), (cost, audit, before) in done.items():
                if at == len(steps):
                    path, item = [q], before
                    while item is not None and item[0] > 0:
                        path.append(item[1])
                        item = done[item][2]
                    made.append({"p": start, "q": q, "cost": cost, "audit": audit, "path": "".join(map(str, reversed(path)))})
        out = {"k": rows[0]["k"], "idx": rows[0]["idx"] // FAN, **dict(zip(FACTS, facts, strict=True)), "rules": made}
        return pa.Table.from_pylist([out], schema=group.schema)

    return level.groupBy("k", F.floor(F.col("idx") / FAN).alias("g")).applyInArrow(run, level.schema)


def with_rules(segments: DataFrame) -> DataFrame:
    """The lowest level: k, idx, the facts, and the rules of each segment from its shape."""
    rows = segments.select("k", "idx", *FACTS, "shape")
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(f"rules {RULE}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())]))
        for b in batches:
            for at in range(0, b.num_rows, FAN):
                part = b.slice(at, FAN)
                found = [[{"p": p, "q": q, "cost": cost, "audit": audit, "path": str(q)} for p in range(4) for q, (cost, audit) in shape_between(shape, p).items()]
                         for shape in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind)], schema.names)

    return rows.mapInArrow(run, schema)


def repair_long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summary and repaired pieces (conv, piece, turns) of conversations of any length."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = materialise(numbered(materialise(segments_of(rows, tasks), "segments")), "segments")
    levels = [materialise(with_rules(segments), "rules")]
    while levels[-1].agg(F.max("idx")).first()[0] > 0:
        levels.append(materialise(combine(levels[-1]), "rules"))
    goals = F.filter("rules", lambda x: (x["p"] == START) & x["q"].isin(*GOALS))
    best = F.array_min(F.transform(goals, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"), x["q"].alias("q"))))
    top = levels[-1].withColumn("best", best)
    gap = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("distinct")).cast("long")
    summary = top.select(F.col("k").alias("conv"), gap.alias("gaps"), *COUNTS, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))
    chosen = top.select("k", "idx", F.lit(START).alias("p"), F.col("best.q").alias("q"))
    for upper, lower in zip(reversed(levels[1:]), reversed(levels[:-1]), strict=True):
        named = chosen.select(F.col("k").alias("k2"), F.col("idx").alias("up"), "p", "q")
        on = upper.k.eqNullSafe(named.k2) & (upper.idx == named.up)
        taken = F.filter("rules", lambda x: (x["p"] == F.col("p")) & (x["q"] == F.col("q")))[0]["path"]
        paths = upper.join(named, on).select("k2", "up", F.concat(F.col("p").cast("string"), taken).alias("path"))
        below = lower.select("k", "idx")
        at = (F.pmod("idx", F.lit(FAN)) + 1).cast("int")
        state = lambda shift, at=at: F.substr("path", at + F.lit(shift), F.lit(1)).cast("int")
        chosen = below.join(paths, below.k.eqNullSafe(paths.k2) & (F.floor(below.idx / FAN) == paths.up)).select("k", "idx", state(0).alias("p"), state(1).alias("q"))
    chosen = chosen.select(F.col("k").alias("k2"), F.col("idx").alias("up"), "p", "q")
    full = segments.join(chosen, segments.k.eqNullSafe(chosen.k2) & (segments.idx == chosen.up)).select("k", "idx", "shape", "p", "q", "turns")
    schema = T.StructType([T.StructField("conv", rows.schema["k"].dataType), *T.StructType.fromDDL(f"piece long, turns {TURNS}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                shape, p, q = (b.column(c)[at].as_py() for c in ("shape", "p", "q"))
                turns = b.column("turns")[at].values
                audit = shape_between(shape, p)[q][1]
                made = edited(audit, p, turns.field("role").to_pylist(), turns.field("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("k").slice(at, 1), b.column("idx").slice(at, 1), turns_array([made])], schema.names)

    return summary, full.mapInArrow(run, schema)


class Repaired(NamedTuple):
    """whole: conv, gaps, the fault counts, cost, audit and turns (array of role and text) of conversations in one piece.

    long, pieces: the same for longer ones, with the turns in rows (conv, piece, turns), numbered in order; None where there are none.
    """

    whole: DataFrame
    long: DataFrame | None
    pieces: DataFrame | None


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str) -> Repaired:
    """The cheapest repair of every conversation of `df`, ordered by turn (nulls first), ties by role and SHA-256 of the text.

    Null roles and texts are one space; rows with a null conversation are one conversation. A role that is empty or begins
    with another letter than s, u, a can't be kept. Equal rows are duplicates. Only the four named columns are
    read, so others may have any name. An empty table gives no conversations.
    """
    rows = ordered_rows(df, conv, turn, role, text)
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.octet_length("x")).alias("bytes"))
    long = materialise(sizes.where((F.col("n") > SEGMENT_ROWS) | (F.col("bytes") > SEGMENT_BYTES)).select(F.col("k").alias("k2")), "long")
    if long.isEmpty():
        return Repaired(repair_whole(rows), None, None)
    whole = repair_whole(rows.join(long, rows.k.eqNullSafe(long.k2), "left_anti"))
    summary, pieces = repair_long(rows.join(long, rows.k.eqNullSafe(long.k2), "left_semi"))
    return Repaired(whole, summary, pieces)


def rendered(turns: Column) -> Column:
    """`role:text` of each turn, newline-joined."""
    return F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """conv and the SHA-256 of all its pieces, newline-joined.

    The digest of one conversation is a chain, so one task reads its pieces in order, one at a time.
    """
    rows = pieces.where(F.size("turns") > 0).select(F.col("conv").alias("k"), "piece", rendered(F.col("turns")).alias("x"))
    ordered = rows.repartition("k").sortWithinPartitions("k", "piece")
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha256()
        for part, fresh, last in sliced(batches, 1, 1):
            state = hashlib.sha256() if fresh else state
            state.update(b"" if fresh else b"\n")
            state.update(part.column("x")[0].as_buffer())
            if last:
                yield pa.RecordBatch.from_arrays([part.column("k").combine_chunks(), pa.array([state.hexdigest()])], schema.names)

    return ordered.mapInArrow(run, schema)


def digests(found: Repaired) -> DataFrame:
    """conv, the counts, cost, audit and repaired_sha256 of every conversation."""
    columns = ["conv", "gaps", *COUNTS, "cost", "audit"]
    out = found.whole.select(*columns, F.sha2(rendered(F.col("turns")), 256).alias("repaired_sha256"))
    if found.long is None:
        return out
    hashed = piece_digests(found.pieces)
    nothing = F.sha2(F.lit(""), 256)
    longer = found.long.join(hashed, found.long.conv.eqNullSafe(hashed.k), "left").select(*columns, F.coalesce("sha256", nothing).alias("repaired_sha256"))
    return out.unionByName(longer)


def damage(df: DataFrame) -> DataFrame:
    """Rows of a conversations table, damaged by the CRC-32 of `conv_id:turn` modulo 20."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    h = F.pmod(F.crc32(F.concat_ws(":", *plain)), F.lit(20))
    text = F.coalesce(F.col("text"), F.lit(" "))
    rows = df.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), h.alias("h")).where("h <> 0")
    rows = rows.withColumn("text", F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("h") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def _value(v: str, cost: str, letter: str, line: str) -> str:
    return f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 'x': {v}.x || {line}}}"


def _least(*values: str) -> str:
    return f"list_min([{', '.join(values)}])"


def _dp(v: str) -> str:
    """SQL of the values w0 to w3 after one row (r, x, d, t) from those before it, without insertions."""
    none = "{'c': 1000000000, 'a': '', 'x': ''}"
    line = "chr(10) || r || ':' || x"

    def on(initial: str, *values: str) -> list[str]:
        return [f"CASE WHEN NOT d AND r[1] = '{initial}' THEN {_value(x, 't', 'K', line)} ELSE {none} END" for x in values]

    def rerole(role: str, *values: str) -> list[str]:
        return [f"CASE WHEN NOT d THEN {_value(x, '(2 + t)', 'R', f'chr(10) || {role!r} || chr(58) || x')} ELSE {none} END" for x in values]

    gone = [_value(f"{v}{k}", "3", "D", "''") for k in range(4)]
    into_user = [f"{v}{k}" for k in (0, 1, 3)]
    return ", ".join(f"{x} AS w{k}" for k, x in enumerate([
        gone[0], _least(gone[1], *on("s", f"{v}0")), _least(gone[2], *on("u", *into_user), *rerole("user", *into_user)),
        _least(gone[3], *on("a", f"{v}2"), *rerole("assistant", f"{v}2"))]))


def _closed() -> str:
    """SQL of v0 to v3: w0 to w3 and what one or two insertions make of them."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    ones = [_value(f"w{k}", "2", "I", user) for k in (0, 1, 3)]
    twos = [_value(f"w{k}", "4", "II", f"{user} || {assistant}") for k in (0, 1, 3)]
    return f"w0 AS v0, w1 AS v1, {_least('w2', *ones)} AS v2, {_least('w3', _value('w2', '2', 'I', assistant), *twos)} AS v3"


_SQL = f"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(name, ''),
        lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda s, e: xor(xor(s, e) >> 1, 3988292384::UBIGINT * (xor(s, e) & 1))), 4294967295::UBIGINT) % 20 AS h FROM b),
m AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS r,
             CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS x,
             unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS again FROM c WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(x), again) AS i FROM m),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) > 1 AS seen, rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
             lag(r[1]) OVER (PARTITION BY conv_id ORDER BY i) || r[1] AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
f AS (SELECT *, CASE WHEN body = '' THEN 0 WHEN seen THEN 1 WHEN NOT contains('.!?', right(body, 1)) THEN 2 ELSE 3 END AS fault FROM q),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 0) AS blank,
             count(*) FILTER (WHERE fault = 1) AS duplicate, count(*) FILTER (WHERE fault = 2) AS truncated,
             count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT conv_id, i, n, r, x, fault < 2 AS d, (fault = 2)::INT AS t FROM f),
s AS (SELECT {{'c': 0, 'a': '', 'x': ''}} AS w0, {{'c': 1000000000, 'a': '', 'x': ''}} AS w1, {{'c': 1000000000, 'a': '', 'x': ''}} AS w2, {{'c': 1000000000, 'a': '', 'x': ''}} AS w3),
z AS (SELECT conv_id, 0::BIGINT AS i, {_closed()} FROM k, s
      UNION ALL
      SELECT conv_id, i, {_closed()} FROM (SELECT e.conv_id, e.i, {_dp('z.v')} FROM z JOIN e ON e.conv_id IS NOT DISTINCT FROM z.conv_id AND e.i = z.i + 1)),
g AS (SELECT conv_id, {_least('v0', 'v3')} AS v FROM z WHERE (conv_id, i) IN (SELECT (conv_id, max(i)) FROM e GROUP BY conv_id))
SELECT u.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(substr(v.x, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) u LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM u.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM u.conv_id"""


@query("op11_structure_repair", _SQL)
def op11_structure_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = digests(repair(damage(rows), "conv_id", "turn", "role", "text"))
    ids = rows.select("conv_id").distinct()
    out = ids.join(found, ids.conv_id.eqNullSafe(found.conv), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
