"""Ranked lexical search: an inverted index in shards, searched by variable-block-max WAND.

``build_index`` cuts each partition's documents into shards of bounded size and writes, for every term of a
shard, its postings (gaps between places and frequencies) as a row; nothing is shuffled for it. ``search``
brings together the lists of a shard that a block of queries asks for, with the corpus-wide counts.

In a shard, dynamic programming cuts every list into blocks of varying length: it minimises what the
blocks' maxima lie above the single impacts, and a price per block. The last documents of the blocks that a query
meets divide the shard into cells that no block's edge crosses, and a cell's bound is the sum of its blocks' maxima. Cells are
entered by falling bound until the bound lies below the tenth best score so far. Inside, a document's bound is the sum
over the lists that have it (weak AND), and only one that reaches the threshold is scored. What is skipped can't be
among the best, so results are exact. Each shard gives its k best, and a window ranks them.

Scores are whole numbers: see ``search``. Defined results: null and empty texts have no term and are no result; repeated document rows are results each;
repeated items give one result, and several texts under one item id are ranked apart; ties go to the smaller id, null
ids last; without documents or terms nothing is returned; further columns are left out.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import staged, text_of

SHARD_DOCS = 1 << 15
SHARD_TOKENS = 8_000_000
QUERY_BLOCK = 1_000  # items that are searched together, about
BLOCK_PRICE = 3_000_000  # of a block, in impacts: as much as three postings whose bound is wholly idle
BLOCK_POSTINGS = 64  # of a block at most
LANE = 256  # postings that one run of the dynamic programme divides; a longer list has several
FIRST_CELLS = 64
#: Characters that separate terms; all that is beyond ASCII belongs to terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode()))


# --------------------------------------------------------------------------- index


class _Shard:
    """Documents of a shard while it is built."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.term, self.tf, self.distinct, self.tokens = array("I"), array("I"), array("I"), array("q")
        self.ids: list = []
        self.words = 0

    def add(self, doc_id, words: list[bytes]) -> None:
        counts = Counter(words)
        at = self.terms
        self.term.extend([at.setdefault(w, len(at)) for w in counts])
        self.tf.extend(counts.values())
        self.distinct.append(len(counts))
        self.tokens.append(len(words))
        self.words += len(words)
        self.ids.append(doc_id)

    def batch(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row per term, after one of the documents; places follow the order of ids."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda d: (True, 0) if self.ids[d] is None else (False, self.ids[d]))
        place = np.empty(n, "u8")
        place[order] = np.arange(n, dtype="u8")
        term = np.frombuffer(self.term, "u4")
        key = term.astype("u8") << np.uint64(32) | np.repeat(place, np.frombuffer(self.distinct, "u4"))
        by = np.argsort(key)
        docs = (key[by] & np.uint64(0xFFFFFFFF)).astype("i8")
        df = np.bincount(term, minlength=len(self.terms))
        starts = np.cumsum(df) - df
        gaps = np.diff(docs, prepend=0)
        gaps[starts] = docs[starts]
        tokens = np.frombuffer(self.tokens, "i8")
        tf = np.frombuffer(self.tf, "u4")[by]
        ends = np.concatenate([np.zeros(1, "i8"), starts + df])

        def lists(values: np.ndarray, first: bytes) -> pa.Array:
            offsets = np.concatenate([np.zeros(1, "i8"), len(first) + 4 * ends])
            data = first + values.astype("<u4").tobytes()
            return pa.Array.from_buffers(pa.large_binary(), len(df) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())

        columns = [
            pa.array(np.full(len(df) + 1, number)),
            pa.array([None, *self.terms], pa.binary()).cast(pa.string()),
            pa.array(np.concatenate([[n], df])),
            pa.array([self.words, *[None] * len(df)], pa.int64()),
            lists(gaps, b""),
            lists(tf, tokens[order].astype("<u4").tobytes()),
            pa.array([[self.ids[d] for d in order if self.ids[d] is not None], *[None] * len(df)], schema.field("ids").type),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of all documents, staged in the shared folder: shard, term, df, tokens, gaps, tfs, ids.

    A row per shard and term: documents with the term, gaps between their places and frequencies (unsigned 32-bit).
    A shard's row without a term has its documents: their number, their terms with repeats in all and (tfs) each, and ids by place (null ids have the last places and aren't listed).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        shard, number, schema = _Shard(), 0, None
        for batch in batches:
            ids = pa.list_(batch.schema.field("i").type)
            schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("tokens", pa.int64()), ("gaps", pa.binary()), ("tfs", pa.binary()), ("ids", ids)])
            for i, text in zip(batch.column("i").to_pylist(), batch.column("t"), strict=True):
                words = text.as_buffer().to_pybytes().translate(_BYTES).split()
                if words:
                    shard.add(i, words)
                if len(shard.ids) >= shard_docs or shard.words >= SHARD_TOKENS:
                    yield shard.batch(first + number, schema)
                    shard, number = _Shard(), number + 1
        if shard.ids:
            yield shard.batch(first + number, schema)

    rows = docs.select(docs[id_col].alias("i"), text_of(docs, text_col).alias("t"))
    return staged(rows.mapInArrow(build, f"shard long, term string, df long, tokens long, gaps binary, tfs binary, ids array<{kind}>"), "search-index")


# --------------------------------------------------------------------------- blocks


def block_ends(impact: np.ndarray, sizes: np.ndarray, price: int = BLOCK_PRICE, most: int = BLOCK_POSTINGS) -> np.ndarray:
    """Where the blocks of lists that lie end to end, sizes long each, end.

    Within a lane (LANE postings of a list, or its rest) the blocks have the least sum of maximum times length, which is the
    idle part of the bounds and a constant, and price a block. Lanes of like length are worked on side by side.
    """
    lanes = -(-sizes // LANE)
    number = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = np.repeat(np.cumsum(sizes) - sizes, lanes) + number * LANE
    length = np.minimum(np.repeat(sizes, lanes) - number * LANE, LANE)
    ends = []
    width = 1
    while width <= LANE:
        chosen = np.flatnonzero((length <= width) & (length > width // 2))
        for part in np.array_split(chosen, -(-len(chosen) * width // (1 << 18)) or 1):
            if len(part):
                ends.append(_lane_ends(impact, start[part], length[part], width, price, most))
        width *= 2
    return np.sort(np.concatenate(ends)) if ends else np.zeros(0, "i8")


def _lane_ends(impact: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, price: int, most: int) -> np.ndarray:
    rows = np.arange(len(start))
    # a column per posting; behind a lane's end stands its last posting again, which no cut looks at
    values = impact[start + np.minimum(np.arange(width)[:, None], length - 1)]
    cost = np.zeros((width + 1, len(start)), "i8")
    before = np.zeros((width + 1, len(start)), "i4")
    top = np.zeros((width, len(start)), "i8")
    for end in range(1, width + 1):
        low = max(0, end - most)
        np.maximum(top[low:end], values[end - 1], out=top[low:end])
        total = cost[low:end] + top[low:end] * np.arange(end - low, 0, -1)[:, None]
        best = total.argmin(0)
        before[end] = best + low
        cost[end] = total[best, rows] + price
    at, ends = length.copy(), []
    while len(rows):
        ends.append(start[rows] + at)
        at = before[at, rows]
        rows, at = rows[at > 0], at[at > 0]
    return np.concatenate(ends)


# --------------------------------------------------------------------------- search


class Lists:
    """The lists of a shard with impacts and blocks."""

    def __init__(self, docs: np.ndarray, tf: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> None:
        self.docs, self.ends = docs, np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
        cuts = block_ends(self.impact, sizes)
        begins = np.concatenate([np.zeros(1, "i8"), cuts[:-1]])
        self.first, self.last = docs[begins], docs[cuts - 1]
        self.top = np.maximum.reduceat(self.impact, begins)
        self.bound = np.repeat(self.top, cuts - begins)  # of a posting's block
        self.block_starts, self.block_ends = np.searchsorted(begins, self.starts), np.searchsorted(begins, self.ends)

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents above 0, ties by place."""
        blocks = _ranges(self.block_starts[lists], self.block_ends[lists])
        bound = self.top[blocks] * np.repeat(weights, self.block_ends[lists] - self.block_starts[lists])
        edges = np.unique(self.last[blocks])
        change = np.zeros(len(edges) + 1, "i8")
        np.add.at(change, np.searchsorted(edges, self.first[blocks]), bound)
        np.add.at(change, np.searchsorted(edges, self.last[blocks]) + 1, -bound)
        bound = np.cumsum(change[:-1])
        cells = np.argsort(-bound, kind="stable")
        place, score = np.zeros(0, "i8"), np.zeros(0, "i8")
        at, step = 0, FIRST_CELLS
        while at < len(cells):
            least = int(score[k - 1]) if len(score) >= k else 1
            live = cells[at : at + step]
            live = np.sort(live[bound[live] >= least])
            if not len(live):
                break
            found = self._scored(lists, weights, edges, live, least)
            place, score = np.concatenate([place, found[0]]), np.concatenate([score, found[1]])
            order = np.lexsort((place, -score))[:k]
            place, score = place[order], score[order]
            at, step = at + step, 2 * step
        return place, score

    def _scored(self, lists: np.ndarray, weights: np.ndarray, edges: np.ndarray, live: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of a few cells' documents that reach least."""
        joined = np.flatnonzero(np.diff(live, prepend=-2) != 1)  # neighbouring cells are one range
        low = np.where(live[joined] > 0, edges[live[joined] - 1] + 1, 0)
        high = edges[live[np.append(joined[1:], len(live)) - 1]] + 1
        begins, stops, weight = [], [], []
        for x, w in zip(lists.tolist(), weights.tolist(), strict=True):
            a, own = self.starts[x], self.docs[self.starts[x] : self.ends[x]]
            begins.append(a + np.searchsorted(own, low))
            stops.append(a + np.searchsorted(own, high))
            weight.append(np.repeat(w, int((stops[-1] - begins[-1]).sum())))
        posting, weight = _ranges(np.concatenate(begins), np.concatenate(stops)), np.concatenate(weight)
        if not len(posting):
            return posting, posting
        docs = self.docs[posting]
        base = int(docs.min())
        reach = np.zeros(int(docs.max()) - base + 1, "i8")
        np.add.at(reach, docs - base, weight * self.bound[posting])
        kept = reach[docs - base] >= least
        docs, posting, weight = docs[kept], posting[kept], weight[kept]
        score = np.zeros(len(reach), "i8")
        np.add.at(score, docs - base, weight * self.impact[posting])
        found = np.flatnonzero(score >= least)
        return found + base, score[found]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = ends - starts
    total = np.cumsum(n)
    return np.repeat(starts - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(index: DataFrame, items: DataFrame, k: int = 10, *, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each item's k best documents: item_col, rank int, id_col, score long.

    A term in df of N documents weighs w = floor(1000 ln((2N + 2) / (2df + 1))). One that occurs tf times in a document of n
    terms, of L in all, adds w * (10^9 tf div (1000 tf + 8m)) where m = 25 + 75nN div L, as often as the item has it.
    """
    counts = index.filter("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    n_docs, tokens = int(counts.n), max(int(counts.tokens), 1)
    text = F.translate(text_of(items, text_col), _UPPER, _UPPER.lower())
    item = F.struct(items[item_col].alias("id"), F.md5(text_of(items, text_col)).alias("text"))
    asked = items.select(item.alias("item"), text.alias("t")).distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    words = asked.select("item", F.explode(F.regexp_extract_all("t", F.lit(TERM), F.lit(0))).alias("term"))
    times = words.groupBy("item", "term").agg(F.count("*").alias("times"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    asking = times.groupBy(block.alias("block"), "term").agg(F.collect_list(F.struct("item", "times")).alias("asking"))  # about QUERY_BLOCK items at most
    found = index.join(times.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("everywhere"))
    lists = index.join(asking.join(found, "term"), "term").select("block", "shard", "term", "everywhere", "df", "gaps", "tfs", "ids", "asking")
    shards = index.filter("term IS NULL").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grouped = lists.unionByName(shards.select("block", "shard", "term", "df", "gaps", "tfs", "ids"), allowMissingColumns=True)
    id_kind, item_kind = index.schema["ids"].dataType.elementType.simpleString(), asked.schema["item"].dataType.simpleString()

    def best(group: pd.DataFrame) -> pd.DataFrame:
        own = group["term"].isna()
        docs, rows = group[own].iloc[0], group[~own]
        out = []
        if len(rows):
            n = np.frombuffer(docs["tfs"], "<u4").astype("i8")
            sizes = rows["df"].to_numpy("i8")
            gaps = np.frombuffer(b"".join(rows["gaps"]), "<u4").astype("i8")
            run = np.cumsum(gaps)
            starts = np.cumsum(sizes) - sizes
            place = run - np.repeat(run[starts] - gaps[starts], sizes)
            tf = np.frombuffer(b"".join(rows["tfs"]), "<u4").astype("i8")
            lists = Lists(place, tf, sizes, 25 + 75 * n * n_docs // tokens)
            wanted = defaultdict(list)
            for at, (df, asking) in enumerate(zip(rows["everywhere"], rows["asking"], strict=True)):
                w = _weight(n_docs, int(df))
                for x in asking:
                    wanted[x["item"]["id"], x["item"]["text"]].append((at, w * x["times"]))
            ids = docs["ids"]
            for (i, text), terms in wanted.items():
                at, weights = np.array(terms, "i8").T
                for p, s in zip(*lists.best(at, weights, k), strict=True):
                    out.append(({"id": i, "text": text}, ids[p] if p < len(ids) else None, int(s)))
        return pd.DataFrame(out, columns=["item", "doc", "score"])

    each = grouped.groupBy("block", "shard").applyInPandas(best, f"item {item_kind}, doc {id_kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item.id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
