"""Best-fit packing against placing piece by piece, ranked search against scoring every document."""

import bisect
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import best_fit
from tesserae.llm import queries as Q
from tesserae.llm import ranked_search as RS

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))
EXTRA = ["row", "ids", "n", "part", "rank", "term", "shard", "score", "block", "i", "t"]


# --------------------------------------------------------------------------- best fit


def tightest_fit(sizes, window):
    """Open capacities after best-fit decreasing, one piece at a time."""
    opened = []
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(opened, size)
        bisect.insort(opened, (opened.pop(at) if at < len(opened) else window) - size)
    return sorted(opened)


def test_segment_tree():
    rng = random.Random(1)
    for window in (1, 7, 64, 1000):
        opened, reference = best_fit.OpenWindows(window), []
        for k in range(300):
            if rng.random() < 0.6:
                capacity = rng.randint(1, window)
                opened.add(capacity, k, 1)
                reference.append(capacity)
            else:
                least = rng.randint(1, window)
                found = opened.tightest(least)
                assert found == min((c for c in reference if c >= least), default=None)
                if found:
                    opened.take(found)
                    reference.remove(found)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(300):
        window = rng.choice([7, 10, 33, 64])
        counts = {rng.randint(1, window - 1): rng.randint(1, 30) for _ in range(rng.randint(0, 10))}
        runs = best_fit.plan(counts, window)
        filled = defaultdict(list)
        for length, n in counts.items():
            own = sorted((r for r in runs if r.length == length), key=lambda r: r.rank)
            for k in range(n):
                run = next(r for r in reversed(own) if r.rank <= k)
                step, at = divmod(k - run.rank, run.per_window)
                filled[run.first + step].append((run.offset + at * length, length))
        for pieces in filled.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= window
        assert sorted(window - sum(n for _, n in p) for p in filled.values()) == tightest_fit([s for s, n in counts.items() for _ in range(n)], window)


def test_plan_of_many_pieces_is_small():
    rng = random.Random(3)
    counts = {s: rng.randint(1, 10**9) for s in range(1, 1024)}
    runs = best_fit.plan(counts, 1024)
    assert len(runs) < 20_000
    windows = 1 + max(r.first for r in runs)
    assert windows * 1024 >= sum(s * n for s, n in counts.items())


def packed_as(pieces, ids_of, window, end_id):
    """Checks every piece and gives the windows' filling."""
    windows, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == set(ids_of)
    for doc, own in by_doc.items():
        ids, at = [*ids_of[doc], end_id], 0
        for k, p in enumerate(sorted(own, key=lambda p: p.piece)):
            part = ids[at : at + p.length]
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part))) and (k == 0 or p.length == window)
            at += p.length
        assert at == len(ids) and len(own) == -(-len(ids) // window)
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return windows


def test_query_packs_all_documents(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = Q.op12_best_fit_packing(spark, sf).collect()
    windows = packed_as(pieces, {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items()}, 1024, 2)
    short = [p.length for p in pieces if p.length < 1024]
    assert sum(any(p.length < 1024 for p in own) for own in windows.values()) == len(tightest_fit(short, 1024))


def test_odd_texts_are_packed(spark):
    from tokenizers import Tokenizer

    texts = {0: None, 1: "", 2: "a b c", 3: LONG, 4: "x", None: "none"} | {n: "one hot text" for n in range(10, 400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({c: F.lit("k") for c in EXTRA}).repartition(7)
    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}
    pieces = best_fit.pack_best_fit(df, Q.tokenizer_path(), window=64, end_id=7, keep=("part",)).withColumn("ids_crc32", F.crc32("ids"))
    rows = pieces.collect()
    packed_as(rows, ids, 64, 7)
    assert all(r.part == "k" for r in rows)
    twice = best_fit.pack_best_fit(df.union(df), Q.tokenizer_path())
    assert twice.groupBy("doc_id").agg(F.sum("length").alias("n")).filter("doc_id = 2").first().n == 2 * (len(ids[2]) + 1)
    assert best_fit.pack_best_fit(df.limit(0), Q.tokenizer_path()).count() == 0


# --------------------------------------------------------------------------- search


def terms_of(text):
    return re.findall(RS.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k):
    """(item, rank, doc, score) by scoring every document for every item; docs: (id, text) rows."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, tokens = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = set()
    for item, text in set(items):
        scores = []
        for place, (i, c, n) in enumerate(counts):
            m = 25 + 75 * n * n_docs // tokens
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, place))
        out |= {(item, r, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scores)[:k], 1)}
    return out


def found(df):
    return {(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()}


def blocks_cost(impact, ends, price):
    starts = [0, *ends[:-1]]
    return sum((b - a) * max(impact[a:b]) + price for a, b in zip(starts, ends, strict=True))


def test_blocks_are_the_cheapest():
    """Against every way to cut short lists; long ones are cut at lanes, too."""
    rng = np.random.RandomState(4)
    for n in range(1, 11):
        impact = rng.randint(0, 1_000, n)
        ends = RS.block_ends(impact, np.array([n]), price=700, most=4)
        every = [[k + 1 for k in range(n - 1) if cut >> k & 1] + [n] for cut in range(1 << n - 1)]
        fits = [e for e in every if max(b - a for a, b in zip([0, *e[:-1]], e, strict=True)) <= 4]
        assert blocks_cost(impact, ends.tolist(), 700) == min(blocks_cost(impact, e, 700) for e in fits)
    sizes = np.array([1, 700, 3, 256, 257, 64])
    impact = rng.randint(0, 10**6, sizes.sum())
    ends = RS.block_ends(impact, sizes)
    assert set(np.cumsum(sizes)) <= set(ends) and ends[-1] == sizes.sum() and np.diff(ends, prepend=0).max() <= RS.BLOCK_POSTINGS
    assert len(np.unique(ends)) == len(ends) and len(RS.block_ends(impact[:0], np.zeros(0, "i8"))) == 0


def test_cells_are_skipped_and_nothing_is_lost(monkeypatch):
    rng = np.random.RandomState(5)
    sizes = np.array([900, 40, 300, 5])
    docs = np.concatenate([np.sort(rng.choice(4_000, n, replace=False)) for n in sizes])
    tf, m = rng.geometric(0.4, len(docs)), rng.randint(30, 300, 4_000)
    lists = RS.Lists(docs, tf, sizes, m)
    scored = []
    inner = RS.Lists._scored
    monkeypatch.setattr(RS.Lists, "_scored", lambda self, *a: scored.append(a[3]) or inner(self, *a))
    owner = np.repeat(np.arange(4), sizes)
    for chosen in ([0, 1, 2, 3], [0], [2, 1], [3]):
        weights = rng.randint(1, 9_000, len(chosen))
        total = np.zeros(4_000, "i8")
        for x, w in zip(chosen, weights, strict=True):
            total[docs[owner == x]] += w * lists.impact[owner == x]
        want = sorted((-s, d) for d, s in enumerate(total) if s > 0)[:10]
        place, score = lists.best(np.array(chosen), weights, 10)
        assert [(-s, d) for d, s in zip(place, score, strict=True)] == want
    cells = len(np.unique(lists.last))
    assert sum(map(len, scored)) < 4 * cells


@pytest.mark.parametrize("shard_docs, query_block", [(1 << 15, 1_000), (7, 3)])
def test_search_as_brute_force(spark, shard_docs, query_block):
    rng = random.Random(6)
    words = ["The", "the", "Äpfel", "äpfel", "x1", "中文", "a", "of", "rare", "Zebra", "né"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\n", "__"]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(60)] + [(i, "the same words") for i in range(60, 90)] + [(90, None), (91, ""), (92, " ,;"), (None, "rare zebra"), (5, "rare rare x1"), (93, LONG)]
    items = [(1, "the rare zebra the"), (2, "Äpfel ÄPFEL"), (3, "nothing here unseen"), (4, None), (5, ""), (6, "same words word5"), (7, "中文 né a of"), (7, "x1"), (1, "the rare zebra the"), (None, "zebra")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(3) for c in EXTRA}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(3) for c in EXTRA})
    old = RS.QUERY_BLOCK
    RS.QUERY_BLOCK = query_block
    try:
        index = RS.build_index(frame, shard_docs=shard_docs)
        got = found(RS.search(index, asked))
    finally:
        RS.QUERY_BLOCK = old
    assert got == brute_force(docs, items, 10)
    assert index.filter("term IS NULL").count() >= (90 // shard_docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert RS.search(RS.build_index(docs.limit(0)), items).count() == 0 and RS.search(RS.build_index(docs), items.limit(0)).count() == 0
    assert found(RS.search(RS.build_index(docs), items)) == brute_force([(1, "a b")], [(1, "a")], 10)


def test_query(spark, sf):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]
    assert found(Q.op13_ranked_search(spark, sf)) == brute_force(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"), 10)
