"""Best-fit packing: documents into as few windows as best-fit decreasing gives, over the whole corpus at once.

A document is its token ids and an end id. One that is longer than a window is cut into whole windows, its
first piece being what is left over; whole windows are sequences of their own.

Shorter pieces are packed by best-fit decreasing. What decides is a piece's length alone, so the plan is made
from the number of pieces of each length: at most one number per length below the window, however many
documents there are, which bounds what the driver gets. Open windows are kept by their remaining capacity under a
segment tree, which gives the tightest capacity that holds a length in logarithmic time; of equal lengths, each open window
takes as many as fit before the next one is asked, as it stays the tightest, so a run of equal
pieces takes one search per group of equal windows instead of one each. The result is that of placing piece by
piece.

A piece's place in the plan follows from its rank among all pieces of its length: its rank within the
partition that encoded it, and the pieces of that length in the partitions before it. A piece finds its
sequence and offset by a binary search over the plan. No group of equal lengths is brought together.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; null ids pass through;
an empty table gives no piece; further columns are left out, unless ``keep`` names them. Sequence ids are unique but not
dense: whole windows have negative ones.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.bpe import Encoder, by_bytes
from tesserae.llm.common import staged, text_of

RANK_BITS = 42  # of a number made of a length and a rank


class OpenWindows:
    """Groups of equally filled windows by remaining capacity, under a segment tree that knows which capacities occur."""

    def __init__(self, window: int) -> None:
        self._leaves = 1 << window.bit_length()
        self._any = bytearray(2 * self._leaves)
        self._groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # first window, windows

    def _mark(self, capacity: int) -> None:
        node = capacity + self._leaves
        self._any[node] = bool(self._groups[capacity])
        while node > 1:
            node //= 2
            self._any[node] = self._any[2 * node] or self._any[2 * node + 1]

    def add(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self._groups[capacity].append((first, n))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        group = self._groups[capacity].pop()
        self._mark(capacity)
        return group

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open window that is at least so much."""
        node = least + self._leaves
        if self._any[node]:
            return least
        while node > 1:  # up to the first subtree on the right that has one, then down its left edge
            if node % 2 == 0 and self._any[node + 1]:
                node += 1
                while node < self._leaves:
                    node = 2 * node + (not self._any[2 * node])
                return node - self._leaves
            node //= 2
        return None


class Run(NamedTuple):
    """Pieces of one length, from one rank on: so many a window, from a first window and offset on."""

    length: int
    rank: int
    per_window: int
    first: int
    offset: int


def plan(counts: dict[int, int], window: int) -> list[Run]:
    """Best-fit decreasing of so many pieces of each length below the window."""
    opened, runs, windows = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = opened.tightest(length)
            fresh = capacity is None
            if fresh:
                capacity = window
                first, n = windows, -(-left // (window // length))
                windows += n
            else:
                first, n = opened.take(capacity)
            each = capacity // length
            full = min(n, left // each)
            runs.append(Run(length, rank, each, first, window - capacity))
            opened.add(capacity - each * length, first, full)
            placed = full * each
            if full < n and left > placed:  # one more window takes what is left
                opened.add(capacity - (left - placed) * length, first + full, 1)
                full, placed = full + 1, left
            opened.add(capacity, first + full, n - full)
            rank, left = rank + placed, left - placed
    return runs


def _cuts(n: int, window: int) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces: whole windows at its end, the rest first."""
    at = n % window
    if at:
        yield 0, at
    for start in range(at, n, window):
        yield start, window


def _pieces(docs: DataFrame, path: str, window: int, end_id: int, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """A row per piece with its partition and its rank among that partition's pieces of its length (staged)."""
    kept = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    names = ["row", "piece", "start", "length", "ids", "part", "rank"]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts = batch.column("t")
            for a, b in by_bytes(texts):
                flat, ends = encoder.encode_all(texts[a:b])
                owner, rows = [], []
                for doc, ids in enumerate(np.split(flat, ends[:-1])):
                    ids = np.append(ids, end_id).astype("<u4")
                    for k, (start, length) in enumerate(_cuts(len(ids), window)):
                        owner.append(a + doc)
                        rows.append((k, start, length, ids[start : start + length].tobytes(), part, seen[length]))
                        seen[length] += 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(owner)), *columns], names=names)

    row = F.struct(*[docs[c] for c in (id_col, *keep)]).alias("row")
    schema = f"row struct<{kept}>, piece int, start long, length long, ids binary, part long, rank long"
    return staged(docs.select(row, text_of(docs, text_col).alias("t")).mapInArrow(encode, schema), "best-fit")


def pack_best_fit(
    docs: DataFrame, tokenizer_path: str, *, window: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """A row per piece: id_col, kept columns, piece, start, length, ids binary (unsigned 32-bit), sequence_id, offset."""
    pieces = _pieces(docs, tokenizer_path, window, end_id, id_col, text_col, keep)
    whole = pieces.filter(F.col("length") == window)
    whole = whole.withColumn("sequence_id", -1 - (F.shiftleft("part", 32) + F.col("rank"))).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.filter(F.col("length") < window)
    per_part = short.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # below window rows
    runs = np.array(plan(counts, window), "i8").reshape(-1, len(Run._fields))
    key = runs[:, 0] << RANK_BITS | runs[:, 1]
    order = np.argsort(key)
    shared = docs.sparkSession.sparkContext.broadcast((key[order], runs[order]))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        key, runs = shared.value
        length, rank = length.to_numpy(), rank.to_numpy()
        run = runs[np.searchsorted(key, length << RANK_BITS | rank, "right") - 1]
        window, at = np.divmod(rank - run[:, 1], run[:, 2])
        return pd.DataFrame({"sequence_id": run[:, 3] + window, "offset": run[:, 4] + at * length})

    placed = short.join(before, ["part", "length"]).withColumn("_at", place("length", F.col("rank") + F.col("before")))
    placed = placed.select(*whole.columns[:-2], "_at.sequence_id", "_at.offset")
    each = whole.unionByName(placed)
    return each.select(*[F.col("row")[c].alias(c) for c in (id_col, *keep)], "piece", "start", "length", "ids", "sequence_id", "offset")
