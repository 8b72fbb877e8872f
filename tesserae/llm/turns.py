"""Conversation repair: the cheapest edits after which the turns alternate.

Roles must read ``(s?(ua)+)?`` by their initials: an optional system turn, then pairs of user and
assistant, or nothing. A turn is kept (cost 0), given the role user or assistant (2) or deleted (3, and
blank and repeated turns must be); a turn without text is inserted for 2; a truncated turn that stays adds 1.

A dynamic programme runs backward over turns and grammar states and gives what each state has still to pay. The walk
forward then takes, of the edits that lie on a cheapest path, the least letter of D, I, K and R; no two edits of a
letter are open to a state, so the result is the least string of edits among the cheapest.

Turns are dealt by ranges of (conversation, turn, role, text) and sorted, so a conversation lies in one piece whatever
the others hold, and a long one spreads over partitions. A conversation that lies within a partition and has at
most ``SEGMENT`` turns is repaired where it passes. The first and the last of a partition, and longer ones, go on as segments
of at most SEGMENT turns: a segment is a min-plus matrix from the costs at its end to those at its start,
a conversation's matrices are joined from the back, each segment is walked from all four states, and a
conversation's walks are joined from the front. Only these small rows of one conversation meet in a task.

Defined results: null roles and texts are one space; turns are ordered by turn (nulls first), role and text; a null
conversation id is a conversation; a role's initial is its first character, and a role without one, or with another
than s, u and a, can't be kept; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import staged

SEGMENT = 4_096  # turns of a segment, at most
RANGE_TEXT = 64  # characters of a text by which turns of one place and role are dealt
RETAG, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = range(4)
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # by the initial of the next turn
FILL = (("u", 2), ("u", 2), ("a", 3), ("u", 2))  # the one that an edit can put there
ENDS = [0, NEVER, NEVER, 0]
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SPACES = " \t\n\x0b\x0c\r"


# --------------------------------------------------------------------------- damage


def damage(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with planted faults, by a checksum of conversation and turn: conv, turn, role, text, gone.

    Of twenty remainders, 0 drops the turn (gone; it stays as a row), 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    by = F.crc32(F.concat_ws(":", space(conv_col), space(turn_col))) % 20
    text = F.when(by == 1, "").when(by == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    role = F.when(by == 4, "user").otherwise(space(role_col))
    each = rows.select(rows[conv_col].alias("conv"), rows[turn_col].alias("turn"), role.alias("role"), text.alias("text"), (by == 0).alias("gone"), F.when(by == 3, 2).otherwise(1).alias("times"))
    return each.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("_", "times")


# --------------------------------------------------------------------------- programme


def fault(text: str) -> str:
    """blank, truncated, or nothing, of one text."""
    if not _WORD.search(text):
        return "blank"
    return "" if text.rstrip(_SPACES)[-1] in ".!?" else "truncated"


def _inserted(costs: list[int]) -> list[int]:
    """Costs of the states before a turn, where turns may be inserted first."""
    user, assistant = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return [min(costs[0], INSERT + user), min(costs[1], INSERT + user), user, assistant]


def _options(state: int, initial: str, found: str, costs: list[int]) -> Iterator[tuple[str, int, int]]:
    """Edits of a turn in ASCII order without insertion: letter, cost to the end, next state."""
    yield "D", DELETE + costs[state], state
    if found in ("", "truncated"):
        extra = TRUNCATED if found else 0
        to = FOLLOWS[state].get(initial)
        if to is not None:
            yield "K", extra + costs[to], to
        yield "R", RETAG + extra + costs[FILL[state][1]], FILL[state][1]


def backward(turns: list[tuple[str, str]], costs: list[int]) -> list[list[int]]:
    """Costs to the end by place and state, of turns (initial, fault), from the costs behind the last."""
    out = [costs]
    for initial, found in reversed(turns):
        out.append(_inserted([min(c for _, c, _ in _options(s, initial, found, out[-1])) for s in STATES]))
    return out[::-1]


def forward(turns: list[tuple[str, str]], costs: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The least edits from a state, and the state behind them; last: no turn follows."""
    edits = []
    for place, turn in enumerate([*turns, None]):
        while True:
            left, choices = costs[place][state], []
            if turn:
                choices = [(e, to) for e, c, to in _options(state, *turn, costs[place + 1]) if c == left]
            elif not last or left == 0:
                break
            if INSERT + costs[place][FILL[state][1]] == left:
                choices.append(("I", FILL[state][1]))
            edit, state = min(choices)
            edits.append(edit)
            if edit != "I":
                break
    return "".join(edits), state


def matrix(turns: list[tuple[str, str]]) -> list[int]:
    """What each state before the turns pays to reach each state behind them, row by row."""
    by_end = [backward(turns, [0 if s == end else NEVER for s in STATES])[0] for end in STATES]
    return [min(by_end[end][s], NEVER) for s in STATES for end in STATES]


def rebuilt(turns: list[tuple], edits: str, state: int) -> list[tuple]:
    """(edit, turn, role, text) of turns (turn, role, text) under edits, from a state; deleted ones included."""
    out, rest = [], iter(turns)
    for edit in edits:
        turn, role, text = (None, "", "") if edit == "I" else next(rest)
        if edit in "IR":
            initial, state = FILL[state]
            role = ROLES[initial]
        elif edit == "K":
            state = FOLLOWS[state][role[0]]
        out.append((edit, turn, role, text))
    return out


def _faults(turns: list[tuple], seen: set | None = None) -> list[str]:
    """The first fault of each of turns (turn, role, text)."""
    seen, out = set() if seen is None else seen, []
    for _, role, text in turns:
        found = fault(text)
        if found != "blank" and (role, text) in seen:
            found = "duplicate"
        seen.add((role, text))
        out.append(found)
    return out


def _summary(turns: list[tuple], initials: list[str], faults: list[str]) -> dict[str, int]:
    known = [t for t, _, _ in turns if t is not None]
    return {
        "gaps": int(known[-1] - known[0]) + 1 - len(set(known)) if known else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False)),
    }


def _whole(turns: list[tuple]) -> tuple[dict[str, int], int, list[tuple]]:
    """Counts, cost and rebuilt turns of a whole conversation."""
    initials, faults = [r[:1] for _, r, _ in turns], _faults(turns)
    pairs = list(zip(initials, faults, strict=True))
    costs = backward(pairs, _inserted(ENDS))
    edits, _ = forward(pairs, costs, 0, True)
    return _summary(turns, initials, faults), costs[0][0] if turns else 0, rebuilt(turns, edits, 0)


# --------------------------------------------------------------------------- operator


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Repaired conversations of rows (conv, turn, role, text, gone), where gone rows only name their conversation.

    A row per conversation, or per segment of a long one: conv, piece (from 0), pieces, gaps, blank, duplicate, truncated, illegal and cost of the
    whole conversation, and turns: array<struct<edit, turn, role, text>>, deleted ones included.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    key = ["conv", "turn", "role", F.substring("text", 1, RANGE_TEXT)]
    dealt = rows.repartitionByRange(*key).sortWithinPartitions("conv", "turn", "role", "text").select("conv", "turn", "role", "text", "gone")
    edited = f"array<struct<edit string, turn {kinds['turn']}, role string, text string>>"
    counts = ", ".join(f"{c} long" for c in (*COUNTS, "cost"))
    shape = f"conv {kinds['conv']}, segment long, {counts}, turns {edited}"
    passed = staged(dealt.mapInArrow(lambda batches: _pass(batches, segment), shape), "turns")
    done = passed.filter("segment IS NULL").select("conv", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces"), *COUNTS, "cost", "turns")
    return done.unionByName(_by_segments(passed.filter("segment IS NOT NULL").select("conv", "segment", "turns"), kinds, edited, counts))


def _pass(batches: Iterable[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted partition: repaired ones, and (with a segment number) those that may go on elsewhere."""
    number, opening, at, held, schema, out = TaskContext.get().partitionId() << 32, True, None, [], None, []

    def close(ends: bool) -> None:
        """ends: the partition goes on with another conversation."""
        nonlocal held, number, opening
        if ends and not opening:
            counts, cost, turns = _whole(held)
            out.append((at[0], None, *[counts[c] for c in COUNTS], cost, turns))
        else:
            out.append((at[0], number, *[0] * 6, [("", *t) for t in held]))
            number, opening = number + 1, True
        held = []
        if ends:
            opening = False

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        turns = pa.array([[dict(zip(("edit", "turn", "role", "text"), t, strict=True)) for t in x] for x in columns[-1]], schema.field("turns").type)
        return pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns[:-1], schema, strict=False)], turns], schema=schema)

    for batch in batches:
        if schema is None:
            turn = pa.struct([("edit", pa.string()), ("turn", batch.schema.field("turn").type), ("role", pa.string()), ("text", pa.string())])
            schema = pa.schema([("conv", batch.schema.field("conv").type), ("segment", pa.int64()), *[(c, pa.int64()) for c in (*COUNTS, "cost")], ("turns", pa.list_(turn))])
        for conv, turn, role, text, gone in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at is not None and at[0] != conv:
                close(True)
            at = (conv,)
            if len(held) == segment:
                close(False)
            if not gone:
                held.append((turn, role, text))
        if out:
            yield batch_of(out)
            out.clear()
    if at is not None:
        close(False)
        yield batch_of(out)


def _by_segments(segments: DataFrame, kinds: dict[str, str], edited: str, counts: str) -> DataFrame:
    """repair() of conversations that come as segments in order."""
    conv = f"conv {kinds['conv']}, segment long"
    # A text is a repeat across segments if an earlier segment has it; within one, each text is asked for once.
    texts = segments.select("conv", "segment", F.explode(F.array_distinct(F.transform("turns", lambda t: F.sha2(F.concat_ws(":", t["role"], t["text"]), 256)))).alias("h"))
    first = texts.groupBy("conv", "h").agg(F.min("segment").alias("first"))
    again = texts.alias("x").join(first.alias("f"), F.col("x.conv").eqNullSafe(F.col("f.conv")) & (F.col("x.h") == F.col("f.h")) & (F.col("f.first") < F.col("x.segment")))
    again = again.groupBy("x.conv", "x.segment").agg(F.collect_list("x.h").alias("again"))  # at most SEGMENT
    both = segments.alias("t").join(again.alias("a"), F.col("t.conv").eqNullSafe(F.col("a.conv")) & (F.col("t.segment") == F.col("a.segment")), "left")

    def summarise(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw, again in zip(pdf["turns"], pdf["again"], strict=True):
                rows = [(None if pd.isna(t["turn"]) else t["turn"], t["role"], t["text"]) for t in raw]
                faults, initials = _faults(rows), [r[:1] for _, r, _ in rows]
                earlier = set() if again is None else set(again)
                if earlier:
                    keys = [hashlib.sha256(f"{r}:{x}".encode()).hexdigest() for _, r, x in rows]
                    faults = ["duplicate" if f != "blank" and k in earlier else f for f, k in zip(faults, keys, strict=True)]
                known = [int(t) for t, _, _ in rows if t is not None]
                own = _summary(rows, initials, faults)
                out.append({
                    "initials": initials, "faults": faults, "matrix": matrix(list(zip(initials, faults, strict=True))),
                    "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "n_turns": len(set(known)), **{c: own[c] for c in COUNTS[1:]},
                })
            yield pdf[["conv", "segment"]].assign(**pd.DataFrame(out, index=pdf.index))

    shape = f"{conv}, initials array<string>, faults array<string>, matrix array<long>, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long"
    summary = both.select("t.conv", "t.segment", "t.turns", "a.again")
    marked = staged(summary.mapInPandas(summarise, shape), "turns-marked")

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        """Of a conversation: what each segment's end has still to pay, and the counts of all."""
        group = group.sort_values("segment").reset_index(drop=True)
        costs, ends = _inserted(ENDS), []
        for m in group["matrix"][::-1]:
            ends.append(costs)
            costs = [min(int(m[4 * s + e]) + costs[e] for e in STATES) for s in STATES]
        known, total = group.dropna(subset="first_turn"), {c: int(group[c].sum()) for c in COUNTS[1:]}
        edges = [(a, b) for a, b in zip(group["last_initial"], group["first_initial"], strict=True) if a is not None]
        pairs = zip([a for a, _ in edges], [b for _, b in edges][1:], strict=False)
        total["illegal"] += sum(p not in LEGAL for p in pairs)
        shared = int((known["first_turn"].to_numpy()[1:] == known["last_turn"].to_numpy()[:-1]).sum())
        gaps = int(known["last_turn"].iloc[-1] - known["first_turn"].iloc[0]) + 1 - (int(known["n_turns"].sum()) - shared) if len(known) else 0
        return group[["conv", "segment"]].assign(
            ends=ends[::-1], last=[*[False] * (len(group) - 1), True], piece=range(len(group)), pieces=len(group), gaps=gaps, cost=costs[0], **total
        )

    small = marked.select(
        "conv", "segment", "matrix", "first_turn", "last_turn", "n_turns", *COUNTS[1:],
        F.get("initials", F.lit(0)).alias("first_initial"), F.get("initials", F.size("initials") - 1).alias("last_initial"),
    )
    ends = small.groupBy("conv").applyInPandas(joined, f"{conv}, ends array<long>, last boolean, piece long, pieces long, {counts}")

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for initials, faults, end, last in zip(pdf["initials"], pdf["faults"], pdf["ends"], pdf["last"], strict=True):
                turns = list(zip(initials, faults, strict=True))
                costs = backward(turns, [int(c) for c in end])
                walks = [forward(turns, costs, s, last) for s in STATES]
                out.append({"edits": [e for e, _ in walks], "to": [s for _, s in walks]})
            yield pdf[["conv", "segment", "piece", "pieces", *COUNTS, "cost"]].assign(**pd.DataFrame(out, index=pdf.index))

    on = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.segment") == F.col(f"{b}.segment"))
    ready = marked.alias("m").join(ends.alias("e"), on("m", "e")).select("m.conv", "m.segment", "m.initials", "m.faults", *[f"e.{c}" for c in ("ends", "last", "piece", "pieces", *COUNTS, "cost")])
    walks = ready.mapInPandas(walk, f"{conv}, piece long, pieces long, {counts}, edits array<string>, to array<long>")

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        """Of a conversation: the state that each segment starts from, and its edits."""
        group, state, out = group.sort_values("segment"), 0, []
        for edits, to in zip(group["edits"], group["to"], strict=True):
            out.append((state, edits[state]))
            state = int(to[state])
        return group[["conv", "segment", "piece", "pieces", *COUNTS, "cost"]].assign(state=[s for s, _ in out], edits=[e for _, e in out])

    decided = walks.groupBy("conv").applyInPandas(chosen, f"{conv}, piece long, pieces long, {counts}, state long, edits string")

    def rebuild(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("edit", "turn", "role", "text")
        for pdf in batches:
            out = []
            for raw, state, edits in zip(pdf["turns"], pdf["state"], pdf["edits"], strict=True):
                rows = [(None if pd.isna(t["turn"]) else t["turn"], t["role"], t["text"]) for t in raw]
                out.append([dict(zip(names, t, strict=True)) for t in rebuilt(rows, edits, int(state))])
            yield pdf.drop(columns=["state", "edits"]).assign(turns=out)

    last = segments.alias("t").join(decided.alias("d"), on("t", "d")).select("t.conv", "d.piece", "d.pieces", *[f"d.{c}" for c in (*COUNTS, "cost")], "t.turns", "d.state", "d.edits")
    return last.mapInPandas(rebuild, f"conv {kinds['conv']}, piece long, pieces long, {counts}, turns {edited}")


# --------------------------------------------------------------------------- digests


def digests(repaired: DataFrame) -> DataFrame:
    """A row per conversation: conv, counts, cost, audit (edits' letters in order), repaired_sha256 (of its ``role:text`` lines).

    A checksum can't be joined from parts: a conversation of several pieces is read in order, piece after piece, by one task that holds one piece.
    """
    audit = F.array_join(F.transform("turns", lambda t: t["edit"]), "")
    lines = F.array_join(F.transform(F.filter("turns", lambda t: t["edit"] != "D"), lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    kept = F.size(F.filter("turns", lambda t: t["edit"] != "D"))
    plain = repaired.select("conv", "piece", "pieces", *COUNTS, "cost", audit.alias("audit"), lines.alias("lines"), kept.alias("kept"))
    one = plain.filter("pieces = 1").select("conv", *COUNTS, "cost", "audit", F.sha2(F.encode("lines", "UTF-8"), 256).alias("repaired_sha256"))
    several = plain.filter("pieces > 1")
    kind = repaired.schema["conv"].dataType.simpleString()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, any_line, audit, counts = None, None, False, [], ()
        names = ["conv", *COUNTS, "cost", "audit", "repaired_sha256"]
        schema = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((at, *counts, "".join(audit), digest.hexdigest()), schema, strict=True)], names=names)

        for batch in batches:
            schema = [batch.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for r in batch.to_pylist():
                if digest is None or r["piece"] == 0:
                    if digest is not None:
                        yield row()
                    at, digest, any_line, audit, counts = r["conv"], hashlib.sha256(), False, [], tuple(r[c] for c in (*COUNTS, "cost"))
                if r["kept"]:
                    digest.update((("\n" if any_line else "") + r["lines"]).encode())
                    any_line = True
                audit.append(r["audit"])
        if digest is not None:
            yield row()

    dealt = several.repartition("conv").sortWithinPartitions("conv", "piece")
    return one.unionByName(dealt.mapInArrow(read, f"conv {kind}, {', '.join(f'{c} long' for c in (*COUNTS, 'cost'))}, audit string, repaired_sha256 string"))
