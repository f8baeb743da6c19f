"""Repair of a conversation's structure by cheapest edits, found by Hirschberg's divide and conquer (operator 12).

A conversation is read by four states: nothing yet, after the system's message,
after a user's, after an assistant's. Edits keep, delete or rerole a message or
insert an empty one. Costs are minimal sums over states, so a stretch of
messages is a table of four by four costs, and two stretches meet in the middle
at the state where forward and backward costs are least. Every letter of an
audit leads from a state to one other, so of two forward paths neither begins
with the other one, and their order by ASCII is kept as a rank beside the cost:
of states that cost the same, the one whose audit so far is least is crossed.

In Spark, messages are sorted over all tasks and cut into segments of at most
``SEGMENT`` messages, which are reduced to a character a message. Segments are
reduced to cost tables where they lie; the same divide and conquer over these
tables gives the states between segments of one conversation, and then each
segment is repaired by itself, in space linear in its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import cut, in_order, named, ship, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after an inserted or reroled message, and the role that it gets.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: A message's character: its role's initial (x: none of them), as a capital if truncated; ``-`` if it must be deleted.
INITIAL_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ALLOWED = {(START, "s"), (START, "u"), (SYSTEM, "u"), (ASSISTANT, "u"), (USER, "a")}
#: Inserts that end a conversation in an allowed way.
ENDING = ("", "II", "I", "")
#: A segment has at most 2 ** 10 messages.
SEGMENT_BITS = 10

#: Costs and ranks of the four states; a state that cannot be reached has an infinite cost.
Front = tuple[tuple[float, ...], tuple[int, ...]]
NEVER = float("inf")


@lru_cache(maxsize=None)
def moves(code: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, letters) over one message, with inserts before it; of each pair of states the cheapest, ties: ASCII-least."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for first in STATES:
        state, inserts = first, ""
        for _ in range(3):  # a third insert leads where the first one led
            spent = INSERT * len(inserts)
            options = [(state, spent + DELETE, inserts + "D")]
            if code != "-":
                extra = TRUNCATED if code.isupper() else 0
                options.append((NEXT[state], spent + REROLE + extra, inserts + "R"))
                if (state, code.lower()) in ALLOWED:
                    options.append((INITIAL_STATE[code.lower()], spent + KEEP + extra, inserts + "K"))
            for to, cost, letters in options:
                best[first, to] = min(best.get((first, to), (cost, letters)), (cost, letters))
            state, inserts = NEXT[state], inserts + "I"
    return tuple((a, b, *found) for (a, b), found in sorted(best.items()))


def _ranked(found: dict[int, tuple]) -> Front:
    """A front from the best (cost, earlier rank, what orders equal ranks) of each state."""
    order = {s: k for k, s in enumerate(sorted(found, key=lambda s: found[s][1:]))}
    return tuple(found[s][0] if s in found else NEVER for s in STATES), tuple(order.get(s, 4) for s in STATES)


def at_state(state: int) -> Front:
    return tuple(0 if s == state else NEVER for s in STATES), tuple(0 if s == state else 4 for s in STATES)


def forward(codes: str, front: Front) -> Front:
    """The front after some messages."""
    for code in codes:
        cost, rank = front
        found: dict[int, tuple] = {}
        for a, b, c, letters in moves(code):
            if cost[a] < NEVER:
                x = (cost[a] + c, rank[a], letters)
                if b not in found or x < found[b]:
                    found[b] = x
        front = _ranked(found)
    return front


def backward(codes: str, after: Sequence[float]) -> Sequence[float]:
    """The least cost from each state before some messages, if states after them cost ``after``."""
    for code in reversed(codes):
        before = [NEVER] * 4
        for a, b, c, _ in moves(code):
            before[a] = min(before[a], c + after[b])
        after = before
    return after


def ending() -> list[int]:
    return [INSERT * len(e) for e in ENDING]


def crossing(front: Front, after: Sequence[float]) -> int:
    """The state of least total cost; of equal ones that with the ASCII-least audit so far."""
    cost, rank = front
    return min(STATES, key=lambda s: (cost[s] + after[s], rank[s]))


def edits(codes: str, first: int, last: int) -> list[str]:
    """The letters of each message from one state to another: a segment's halves meet at their best crossing."""
    if len(codes) <= 1:
        return [next(x for a, b, _, x in moves(codes) if (a, b) == (first, last))] if codes else []
    half = len(codes) // 2
    meet = crossing(forward(codes[:half], at_state(first)), backward(codes[half:], [0 if s == last else NEVER for s in STATES]))
    return edits(codes[:half], first, meet) + edits(codes[half:], meet, last)


@lru_cache(maxsize=1 << 14)
def repaired_segment(codes: str, first: int, last: int | None) -> tuple[list[str], str, int]:
    """Letters of each message, those of the end (if ``last`` is open) and the cost."""
    front = forward(codes, at_state(first))
    closing = last is None
    if closing:
        last = crossing(front, ending())
    tail = ENDING[last] if closing else ""
    return edits(codes, first, last), tail, int(front[0][last]) + INSERT * len(tail)


def table_of(codes: str) -> list[Front]:
    """The fronts after a segment from each state: a segment's part in the scan over segments."""
    return [forward(codes, at_state(s)) for s in STATES]


def _over(front: Front, segment: list[Front]) -> Front:
    cost, rank = front
    found: dict[int, tuple] = {}
    for a in STATES:
        if cost[a] < NEVER:
            for b in STATES:
                x = (cost[a] + segment[a][0][b], rank[a], segment[a][1][b])
                if x[0] < NEVER and (b not in found or x < found[b]):
                    found[b] = x
    return _ranked(found)


def segment_states(segments: list[list[Front]], first: int = START) -> list[int]:
    """The states before each segment, by the same divide and conquer over the segments' tables."""

    def between(lo: int, hi: int, a: int, after: Sequence[float]) -> list[int]:
        if hi - lo == 1:
            return [a]
        middle = (lo + hi) // 2
        front, back = at_state(a), after
        for k in range(lo, middle):
            front = _over(front, segments[k])
        for k in range(hi - 1, middle - 1, -1):
            back = [min(segments[k][s][0][t] + back[t] for t in STATES) for s in STATES]
        meet = crossing(front, back)
        return between(lo, middle, a, [0 if s == meet else NEVER for s in STATES]) + between(middle, hi, meet, after)

    return between(0, len(segments), first, ending()) if segments else []


# ---------------------------------------------------------------- Spark


def damaged(rows: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) after a repeatable damage by the checksum of conv_id and turn.

    Of 20 checksums, 0 drops the message, 1 empties its text, 2 takes its ends
    of sentences away, 3 repeats it and 4 makes it the user's. Null roles and
    texts become one space; so do a null conv_id and turn in the checksum.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    d = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("kind")).where("kind <> 0")
    d = d.withColumns({
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "copy": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return d.select("conv_id", "turn", "role", "text")


def _messages(rows: DataFrame) -> DataFrame:
    """All messages in order of (conv_id, turn, role, text) with their faults but for duplicates, written once."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    open_end = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    m = in_order(rows.select(named(F.col("conv_id")).alias("conv"), "turn", "role", "text", "conv_id"), ["conv", "turn", "role", "text"], "conversation-order")
    content = F.md5(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text")).cast("binary"))
    return m.withColumns({"blank": blank, "open_end": open_end, "initial": initial, "content": content, "segment": F.shiftright("at", SEGMENT_BITS)})


def _segments(messages: DataFrame) -> DataFrame:
    """A row a segment: its characters, counts of faults, and pairs of roles that do not alternate, the one with the segment before it too."""
    light = messages.select("conv", "segment", "at", "blank", "open_end", "initial", "content")
    first = light.groupBy("conv", "content").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    light = light.join(first, "at", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("open_end"), "truncated")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    light = light.withColumn("fault", fault).withColumn("code", code)
    one = F.array_sort(F.collect_list(F.struct("at", "code", "initial")))
    s = light.groupBy("conv", "segment").agg(one.alias("rows"), *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    s = s.select("conv", "segment", "blank", "duplicate", "truncated", *(F.array_join(F.col("rows")[c], "").alias(c) for c in ("code", "initial")))
    order = W.partitionBy("conv").orderBy("segment")  # segments, each of up to a thousand messages
    s = s.withColumns({"before": F.coalesce(F.lag(F.substring("initial", -1, 1)).over(order), F.lit("")), "last": F.lead("segment").over(order).isNull(), "only": F.count("*").over(W.partitionBy("conv")) == 1})
    line = F.concat("before", "initial")
    pairs = F.transform(F.sequence(F.lit(1), F.length(line) - 1), lambda i: F.substring(line, i, F.lit(2)))
    illegal = F.when(F.length(line) > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    return cut(s.withColumn("illegal", illegal.cast("long")).drop("initial", "before"), "conversation-segments")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat = [[x for front in table_of(c) for part in front for x in part] for c in b["code"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["conv"], b["segment"], pa.array(flat, pa.list_(pa.float64()))], ["conv", "segment", "costs"])


def _states(segments: pd.DataFrame) -> pd.DataFrame:
    """States at the ends of one conversation's segments."""
    s = segments.sort_values("segment")
    tables = [[(tuple(x[8 * k : 8 * k + 4]), tuple(int(r) for r in x[8 * k + 4 : 8 * k + 8])) for k in range(4)] for x in s["costs"]]
    states = segment_states(tables)
    return pd.DataFrame({"conv": s["conv"], "segment": s["segment"], "enters": states, "leaves": pd.array([*states[1:], None], "Int32")})


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [repaired_segment(*x) for x in zip(*(b[c].to_pylist() for c in ("code", "enters", "leaves")), strict=True)]
        columns = [pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.string()), b["enters"].cast(pa.int32()), pa.array([f[2] for f in found], pa.int64())]
        yield pa.RecordBatch.from_arrays([b["conv"], b["segment"], *columns], ["conv", "segment", "letters", "tail", "enters", "cost"])


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired messages from a stream in which the letters of a segment come before its messages."""
    state, letters, tail, conv = START, iter(()), "", None
    for b in batches:
        convs, roles, texts = [], [], []

        def put(c: str, role: str, text: str, convs=convs, roles=roles, texts=texts) -> None:
            convs.append(c)
            roles.append(role)
            texts.append(text)

        def inserted(word: str, put=put) -> None:
            nonlocal state
            for _ in word:
                state = NEXT[state]
                put(conv, ROLE[state], "")

        for c, role, text, plan, end, enters in zip(*(b[n].to_pylist() for n in ("conv", "role", "text", "letters", "tail", "enters")), strict=True):
            if plan is not None:
                inserted(tail)
                conv, letters, tail, state = c, iter(plan), end, enters
                continue
            word = next(letters)
            inserted(word[:-1])
            if word[-1] == "K":
                state = INITIAL_STATE[role[0]]
                put(c, role, text)
            elif word[-1] == "R":
                state = NEXT[state]
                put(c, ROLE[state], text)
        if convs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (convs, roles, texts)], ["conv", "role", "text"])
    rest = []
    for _ in tail:
        state = NEXT[state]
        rest.append(ROLE[state])
    if rest:
        yield pa.RecordBatch.from_arrays([pa.array([conv] * len(rest), pa.string()), pa.array(rest, pa.string()), pa.array([""] * len(rest), pa.string())], ["conv", "role", "text"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of each conversation's lines ``role:text``, from a stream in order."""
    conv, running = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([running.hexdigest()], pa.string())], ["conv", "sha256"])

    for b in batches:
        for c, role, text in zip(*(b[n].to_pylist() for n in ("conv", "role", "text")), strict=True):
            if c != conv:
                if conv is not None:
                    yield row()
                conv, running = c, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
    if conv is not None:
        yield row()


def _repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages in order, segments with their faults, and segments' audits (both written)."""
    ship(rows.sparkSession)
    messages = _messages(rows)
    segments = _segments(messages)
    several = segments.where("NOT only").select("conv", "segment", "code").mapInArrow(_tables, "conv string, segment long, costs array<double>")
    states = several.groupBy("conv").applyInPandas(_states, "conv string, segment long, enters int, leaves int")
    alone = segments.where("only").select("conv", "segment", "code", F.lit(START).alias("enters"), F.lit(None).cast("int").alias("leaves"))
    planned = alone.unionByName(segments.where("NOT only").select("conv", "segment", "code").join(states, ["conv", "segment"]))
    audits = planned.mapInArrow(_audits, "conv string, segment long, letters array<string>, tail string, enters int, cost long")
    return messages, segments, cut(audits, "conversation-audits")


def _stream(messages: DataFrame, audits: DataFrame) -> DataFrame:
    """Repaired messages (conv, role, text), each conversation's together and in order.

    Letters and messages of a conversation go to one task as a stream, in constant
    memory, since the hash of its text is one chain; all else is done by segments.
    """
    nothing = F.lit(None)
    plans = audits.select("conv", "segment", F.lit(-1).cast("long").alias("at"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), "letters", "tail", "enters")
    lines = messages.select("conv", "segment", "at", "role", "text", nothing.cast("array<string>").alias("letters"), nothing.cast("string").alias("tail"), nothing.cast("int").alias("enters"))
    both = plans.unionByName(lines).repartition("conv").sortWithinPartitions("conv", "segment", "at")
    return both.select("conv", "role", "text", "letters", "tail", "enters").mapInArrow(_repairs, "conv string, role string, text string")


def repaired(rows: DataFrame) -> DataFrame:
    """The messages of ``rows`` (conv_id, turn, role, text) after repair: conv (the name of conv_id), role and text, in order within a task."""
    messages, _, audits = _repair(rows)
    return _stream(messages, audits)


def repair(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """A row a conversation: faults found, the cheapest edits (ties: ASCII-least audit) and a hash of what they give.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. ``rows`` are messages (conv_id, turn, role, text) without
    nulls in role and text (``damaged`` gives such; others count as one space);
    conv_id and turn may be null: a null conv_id is a conversation of its own
    and a null turn comes first. Messages of equal turn are in the order of
    role, then text. A role that begins with none of s, u and a cannot be
    kept. Conversations of ``originals`` (default: ``rows``) without messages
    get zeros, an empty audit and the hash of nothing. Very long texts are read
    in the scan and by the hash alone. Repeated rows are duplicates by the
    rules; other columns are ignored; empty tables give an empty result.
    """
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    ids = (rows if originals is None else originals).select("conv_id").distinct().withColumn("conv", named(F.col("conv_id")))
    messages, segments, audits = _repair(rows.select("conv_id", "turn", *(c.alias(n) for n, c in space.items())))
    turns = messages.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    counts = segments.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    parts = F.array_sort(F.collect_list(F.struct("segment", F.concat(F.array_join("letters", ""), "tail").alias("letters"))))
    found = audits.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["letters"]), "").alias("audit"))
    hashes = _stream(messages, audits).mapInArrow(_hashes, "conv string, sha256 string")
    out = ids.join(turns, "conv", "left").join(counts, "conv", "left").join(found, "conv", "left").join(hashes, "conv", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)


