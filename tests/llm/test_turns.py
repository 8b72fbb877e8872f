"""Conversation repair against every sequence of edits, and in segments against whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tesserae.llm import queries as Q
from tesserae.llm import turns as T

COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}


def faults_of(rows):
    """rows: (turn, role, text) in order."""
    out, seen = [], []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = "blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated"
        seen.append((role, text))
        out.append(kind)
    return out


def every_repair(rows, faults):
    """(cost, audit, repaired turns) of all edits, with two insertions a place at most."""
    inserts = ["", "u", "a", "ua", "au"]
    full = {"u": "user", "a": "assistant"}
    options = []
    for (_, role, text), found in zip(rows, faults, strict=True):
        mine = [("D", None)]
        if found not in ("blank", "duplicate"):
            mine += [("K", (role, text)), ("R", ("user", text)), ("R", ("assistant", text))]
        options.append(mine)
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(*options):
            audit, out, cost = "", [], 0
            for place, gap in enumerate(gaps):
                audit += "I" * len(gap)
                out += [(full[g], "") for g in gap]
                if place < len(rows):
                    edit, turn = edits[place]
                    audit += edit
                    if turn:
                        out.append(turn)
                        cost += faults[place] == "truncated"
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                yield cost + sum(COSTS[e] for e in audit), audit, out


def expected(rows):
    """A conversation's digest by brute force."""
    faults = faults_of(rows)
    cost, audit, out = min(every_repair(rows, faults)) if rows else (0, "", [])
    known = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


@pytest.fixture(scope="module")
def few():
    """Random short conversations: conv to (turn, role, text)."""
    rng = random.Random(5)
    texts = ["One.", "Two", "", " \t", "Three!", "Vier ?", "nö"]
    out = {None: [(None, "user", "Hi."), (1, "assistant", "So.")]}
    for conv in range(150):
        out[conv] = [(rng.choice([None, 0, 1, 2, 5, 5]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " "]), rng.choice(texts)) for _ in range(rng.randint(0, 3))]
    return out


def frame(spark, conversations):
    rows = [(c, *t, False) for c, ts in conversations.items() for t in ts] + [(c, None, " ", " ", True) for c in conversations]
    return spark.createDataFrame(rows, "conv long, turn long, role string, text string, gone boolean")


def digest(df):
    return {r.conv: tuple(r)[1:] for r in T.digests(df).collect()}


@pytest.mark.parametrize("segment", [4_096, 1, 2])
def test_brute_force(spark, few, segment):
    got = digest(T.repair(frame(spark, few).repartition(5), segment))
    assert got == {c: expected(ordered(ts)) for c, ts in few.items()}


def test_segments_of_long_conversations(spark):
    rng = random.Random(6)
    make = lambda n: [(rng.randrange(n), rng.choice(["user", "assistant", "system"]), f"{rng.randrange(n)}{rng.choice('.!? ,')}") for _ in range(n)]
    long = {c: make(n) for c, n in enumerate([400, 90, 1, 300])}
    df = frame(spark, long)
    pieces = T.repair(df, 16)
    assert digest(pieces) == digest(T.repair(df)) and max(len(r.turns) for r in pieces.collect()) < 80
    for conv, turns in long.items():
        faults = faults_of(ordered(turns))
        assert digest(pieces)[conv][1:4] == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))


def test_one_conversation_holds_most_turns(spark):
    turns = [(0, "user", "again.")] * 3_000 + [(1, "assistant", f"{i}.") for i in range(3_000)]
    got = digest(T.repair(frame(spark, {7: turns, 8: [(0, "user", "a."), (1, "assistant", "b.")]}), 256))
    assert got[7][2] == 2_999 and got[7][5] == 3 * 2_999 + 2 * 1_500 and got[8][5:7] == (0, "KK")


def test_repaired_turns(spark):
    rows = {1: [(0, "assistant", "a."), (1, "assistant", "b"), (2, "user", "")]}
    (got,) = T.repair(frame(spark, rows)).collect()
    assert got.cost == 6 and [tuple(t) for t in got.turns] == [("R", 0, "user", "a."), ("K", 1, "assistant", "b"), ("D", 2, "user", "")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.digests(T.repair(T.damage(df))).count() == 0


def test_clashing_names(spark):
    rows = [(1, 0, None, None, 1, 2), (None, None, "user", "x.", 1, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone long, conv long")
    assert {r.conv for r in T.digests(T.repair(T.damage(df))).collect()} == {1, None}


def test_query(spark, sf):
    """The query against damage and brute force in plain Python, over the whole table."""
    rows, conversations = spark.read.parquet(f"{sf}/conversations.parquet").collect(), defaultdict(list)
    for r in rows:
        role, text = (" " if x is None else x for x in (r.role, r.text))
        key = ":".join(" " if x is None else str(x) for x in (r.conv_id, r.turn))
        by = zlib.crc32(key.encode()) % 20
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        conversations[r.conv_id] += [(r.turn, "user" if by == 4 else role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    got = {r.conv_id: r for r in Q.op11_conversation_repair(spark, sf).collect()}
    assert set(got) == set(conversations)
    for conv, turns in conversations.items():
        r = got[conv]
        counts = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal)
        if len(turns) <= 3:
            assert (*counts, r.cost, r.audit, r.repaired_sha256) == expected(ordered(turns))
        else:
            faults = faults_of(ordered(turns))
            assert counts[1:4] == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
            assert len(r.audit.replace("I", "")) == len(turns)
