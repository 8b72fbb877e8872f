"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Texts are encoded once and staged in the shared folder with a lexical key each, together with each
partition's document frequencies, which are summed over all documents (a vector as long as the vocabulary, which
bounds what is broadcast). Documents are then dealt by ranges of their keys: the key names the highest of
the document's token ids, which are the rarest by the vocabulary's own order, so that documents which share
rare ids come to lie together wherever their files were; equal keys are dealt by a hash of the ids, so that a
large group of copies spreads. A range's documents in key order are cut into index shards of at most
``SHARD_DOCS`` documents or ``SHARD_TOKENS`` tokens, each with an inverted index from token ids to BM25 weights.

The document that opens a window is its seed: the best unused neighbours by all of its token ids follow it,
the last one is cut where the window ends, and its rest opens the next window as the new seed. Neighbours are
ranked to the last one, and a seed whose shard is used up asks the next shard of its range; a document in key order follows
only where no unused one shares a token id with the seed. Only a range's last window is padded.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; null
ids pass through; an empty table gives no piece; further columns are left out, unless ``keep``
names them, which come back on every piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.bpe import Encoder, by_bytes, vocabulary
from tesserae.llm.common import staged, text_of

SHARD_DOCS = 2048
SHARD_TOKENS = 4_000_000
RANGE_TOKENS = 8_000_000  # tokens of a range of keys, about
KEY_TERMS, KEY_BITS = 3, 21
QUERY_TERMS = NEIGHBOURS = None  # a bound on a seed's token ids and on its ranked neighbours; None: all
FREQUENT = 16  # token ids in a share of 1 / FREQUENT of a shard's documents are scored by one matrix product
K1, B = 1.2, 0.75
Piece = tuple[int, int, int, int, int]


class Shard:
    """The inverted index of some documents' token ids."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_tokens: float) -> None:
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
        n = np.array([len(t) for t in terms])
        all_terms, tf = np.concatenate(terms), np.concatenate(counts).astype("f4")
        tokens = np.repeat(np.array([len(d) for d in docs], "f4"), n)
        weight = idf[all_terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tokens / max(mean_tokens, 1.0)))
        order = np.argsort(all_terms, kind="stable")
        self._docs = np.repeat(np.arange(len(docs), dtype="i4"), n)[order]
        self._weights = weight[order]
        self._ends = np.searchsorted(all_terms[order], np.arange(len(idf) + 1))
        frequent = np.diff(self._ends) * FREQUENT > len(docs)
        place = np.cumsum(frequent) - 1
        weights = np.zeros((int(frequent.sum()), len(docs)), "f4")
        asked = np.zeros((len(docs), len(weights)), "f4")
        starts = np.cumsum([0, *n])
        self._place, self._frequent, self._dense = place, frequent, weights
        self._query, self.terms = [], terms
        for k, t in enumerate(terms):
            w = weight[starts[k] : starts[k + 1]]
            often = frequent[t]
            weights[place[t[often]], k] = w[often]
            query = t if QUERY_TERMS is None else t[np.argsort(-w, kind="stable")[:QUERY_TERMS]]
            often = frequent[query]
            asked[k, place[query[often]]] = 1
            self._query.append(query[~often])
        self._scores = asked @ weights  # a row per seed
        self.unused = np.ones(len(docs), bool)

    def neighbours(self, seed: int) -> list[int]:
        """Unused documents by falling score, then by place."""
        return self._ranked(self._scores[seed].astype("f8"), self._query[seed])

    def neighbours_of(self, terms: np.ndarray) -> list[int]:
        """As neighbours, of a document of another shard."""
        often = self._frequent[terms]
        return self._ranked(self._dense[self._place[terms[often]]].sum(0, dtype="f8"), terms[~often])

    def _ranked(self, score: np.ndarray, rare: np.ndarray) -> list[int]:
        spans = [slice(a, b) for a, b in zip(self._ends[rare], self._ends[rare.astype("i8") + 1], strict=True)]
        if spans:
            docs = np.concatenate([self._docs[x] for x in spans])
            score += np.bincount(docs, np.concatenate([self._weights[x] for x in spans]), len(score))
        found = np.flatnonzero((score > 0) & self.unused)
        return found[np.argsort(-score[found], kind="stable")][:NEIGHBOURS].tolist()


class Packer:
    """Fills windows across the shards of one partition."""

    def __init__(self, window: int, first_sequence: int, idf: np.ndarray, mean_tokens: float) -> None:
        self._window, self._sequence, self._offset = window, first_sequence, 0
        self._idf, self._mean = idf, mean_tokens
        self._seed = np.zeros(0, "i8")

    def _place(self, doc: int, n: int) -> Iterator[Piece]:
        start = 0
        while start < n:
            length = min(n - start, self._window - self._offset)
            yield doc, start, length, self._sequence, self._offset
            start += length
            self._offset += length
            if self._offset == self._window:
                self._sequence, self._offset = self._sequence + 1, 0

    def pack(self, docs: list[np.ndarray]) -> Iterator[Piece]:
        """(document, start, length, sequence, offset) of every piece."""
        shard = Shard(docs, self._idf, self._mean)
        waiting = iter(range(len(docs)))
        following = shard.neighbours_of(self._seed)[::-1] if self._offset else []  # the open window's seed asks here, too

        def unused() -> int | None:
            while following:
                if shard.unused[d := following.pop()]:
                    return d
            return next((d for d in waiting if shard.unused[d]), None)

        while (doc := unused()) is not None:
            shard.unused[doc] = False
            before = self._sequence, self._offset
            yield from self._place(doc, len(docs[doc]))
            if not self._offset:
                following = []
            elif self._sequence != before[0] or not before[1]:  # this document opens the window
                self._seed, following = shard.terms[doc], shard.neighbours(doc)[::-1]


def _key(terms: np.ndarray) -> int:
    """The highest token ids, highest first, in one number."""
    key = 0
    for t in [*terms[: -KEY_TERMS - 1 : -1].tolist(), *[0] * KEY_TERMS][:KEY_TERMS]:
        key = key << KEY_BITS | t & (1 << KEY_BITS) - 1
    return key


def _encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """A row per document (row, ids, n, key), and one per partition with its document frequencies (df)."""
    kept = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    names = ["row", "ids", "n", "key", "df"]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        df = np.zeros(len(encoder.vocabulary.token_bytes), "u4")
        kind = _kind(len(df))
        shape = None
        for batch in batches:
            shape, texts = batch.schema.field("row").type, batch.column("t")
            for a, b in by_bytes(texts):
                flat, ends = encoder.encode_all(texts[a:b])
                ids, n, keys = [], [], []
                for x in np.split(flat, ends[:-1]):
                    x = np.append(x, end_id).astype(kind)
                    terms = np.unique(x)
                    df[terms] += 1
                    ids.append(x.tobytes())
                    n.append(len(x))
                    keys.append(_key(terms))
                columns = [batch.column("row")[a:b], pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(b - a, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if shape is not None:
            none = [pa.nulls(1, t) for t in (shape, pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([df.tobytes()], pa.binary())], names=names)

    row = F.struct(*[docs[c] for c in (id_col, *keep)]).alias("row")
    rows = docs.select(row, text_of(docs, text_col).alias("t")).mapInArrow(encode, f"row struct<{kept}>, ids binary, n long, key long, df binary")
    return staged(rows, "packing")


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _frequencies(encoded: DataFrame, size: int) -> np.ndarray:
    """Document frequency by token id, over all documents."""

    def spread(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, "i8")
        for pdf in batches:
            for x in pdf["df"]:
                total += np.frombuffer(x, "<u4")
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    sums = encoded.filter("df is not null").select("df").mapInPandas(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(size)
    for r in sums.collect():  # at most one row per token id
        out[r.id] = r.n
    return out


def pack(
    docs: DataFrame, tokenizer_path: str, *, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """A row per piece: id_col, kept columns, start, length, ids binary (unsigned 32-bit), doc_tokens, sequence_id, offset."""
    encoded = _encoded(docs, tokenizer_path, end_id, id_col, text_col, keep)
    spark = docs.sparkSession
    texts = encoded.filter("ids is not null")
    sizes = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    df = _frequencies(encoded, len(vocabulary(tokenizer_path).token_bytes))
    idf = np.log1p((sizes.n - df + 0.5) / (df + 0.5)).astype("f4")
    shared, mean = spark.sparkContext.broadcast(idf), sizes.tokens / max(sizes.n, 1)
    ranges = max(spark.sparkContext.defaultParallelism, -(-sizes.tokens // RANGE_TOKENS))
    dealt = texts.select("row", "ids", "n", "key", F.xxhash64("row", "ids").alias("h")).repartitionByRange(ranges, "key", "h").sortWithinPartitions("key", "h")

    def fill(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf = shared.value
        kind = _kind(len(idf))
        packer = Packer(window, TaskContext.get().partitionId() << 36, idf, mean)

        def shards() -> Iterator[list]:
            held, tokens = [], 0
            for pdf in batches:
                for row, ids, n in zip(pdf["row"], pdf["ids"], pdf["n"], strict=True):
                    held.append((row, np.frombuffer(ids, kind)))
                    tokens += n
                    if len(held) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                        yield held
                        held, tokens = [], 0
            if held:
                yield held

        for held in shards():
            out = []
            for d, start, length, sequence, offset in packer.pack([x for _, x in held]):
                row, ids = held[d]
                out.append((row, start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), sequence, offset))
            yield pd.DataFrame(out, columns=["row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = encoded.schema["row"].dataType.simpleString()
    pieces = dealt.select("row", "ids", "n").mapInPandas(fill, f"row {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    rest = [c for c in pieces.columns if c != "row"]
    return pieces.select(*[F.col("row")[c].alias(c) for c in (id_col, *keep)], *rest)
