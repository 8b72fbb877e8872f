"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and lets a tree of few leaves over that
feature's bins correct the log loss; what the trees add up to is one lookup table per feature.
Then the pairs of features with the largest gain on the residuals get tables of their own. A
score is a sum of looked-up values, so it is vectorised over rows and explainable by feature.

Training takes a bounded sample of labelled rows (``TRAINING_ROWS``, the smallest by a hash of
the id) that are not held out (crc32 of the id as text, mod 4, is not 2). Inputs are measured
from the text alone.

Defined results: null and empty texts are scored as texts without words; null ids pass through
and are not held out; several labels of one document count as their mean, rounded; null labels
are left out; without any labelled row every score is 1; repeated rows get repeated results; of several texts
of one labelled document the one with the smallest measurements is learnt from, so a fit can be repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserae.llm.common import own_name, text_of

TRAINING_ROWS = 8_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 80, 30, 0.2, 3

FEATURES = (
    "log_words", "word_length", "upper", "symbols", "pipes", "bangs", "digits", "stops", "commas",
    "words_per_line", "repeated_lines", "repeated_word", "distinct_words", "compressed", "words_per_stop",
)


def measure(text: str) -> tuple[float, ...]:
    """One value per feature, from the whole text."""
    raw = text.encode("utf-8", "replace")
    h = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, n_lines, size = max(len(words), 1), max(len(lines), 1), max(len(raw), 1)
    upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
    stops = int(h[46] + h[63])
    return (
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        upper / max(upper + lower, 1),
        int(h[[35, 36, 37, 38, 42, 60, 62]].sum()) / n,
        int(h[124]) / n,
        int(h[33]) / n,
        int(h[48:58].sum()) / size,
        stops / n,
        int(h[44]) / n,
        len(words) / n_lines,
        1 - len(set(lines)) / n_lines if lines else 0.0,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        len(zlib.compress(raw, 1)) / (size + 12),
        len(words) / (stops + 1),
    )


def measure_all(texts: Iterable[str]) -> np.ndarray:
    return np.array([measure(t) for t in texts], "f8").reshape(-1, len(FEATURES))


# --------------------------------------------------------------------------- the model


def _bin(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, values, side="right")


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    score = lambda a, b: a * a / (b + 1.0)
    gain = score(gl, hl) + score(g.sum() - gl, h.sum() - hl) - score(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Value per bin of a tree with at most that many leaves, grown by best gain."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        found = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in spans]
        gain, k, a, b = max(found)
        if gain <= 1e-9:
            break
        spans.remove((a, b))
        spans += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features of a pair once."""
    rows, cols = g.shape
    best, out = -1.0, np.zeros_like(g)
    for i in range(1, rows):
        for j in range(1, cols):
            parts = [np.s_[:i, :j], np.s_[:i, j:], np.s_[i:, :j], np.s_[i:, j:]]
            sums = [(g[p].sum(), h[p].sum()) for p in parts]
            gain = sum(a * a / (b + 1.0) for a, b in sums)
            if gain > best + 1e-12:
                best, out = gain, np.zeros_like(g)
                for p, (a, b) in zip(parts, sums, strict=True):
                    out[p] = a / (b + 1.0)
    return best, out


def _chance(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[_bin(x[:, j], cuts)]
        for i, j, ci, cj, values in self.pairs:
            total += values[_bin(x[:, i], ci), _bin(x[:, j], cj)]
        return _chance(total)


def fit(x: np.ndarray, y: np.ndarray) -> Model | None:
    """None without rows."""
    if not len(y):
        return None
    ends = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    cuts = [ends(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [_bin(x[:, j], c) for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            q = _chance(total)
            step = RATE * _tree(np.bincount(b, y - q, len(tables[j])), np.bincount(b, q * (1 - q), len(tables[j])))
            tables[j] += step
            total += step[b]
    coarse = [ends(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cbins = [_bin(x[:, j], c) for j, c in enumerate(coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        at, q = cbins[i] * shape[1] + cbins[j], _chance(total)
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - q, q * (1 - q)))

    gains = sorted(((_quadrants(*sums(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, values in pairs:
            step = RATE * _quadrants(*sums(i, j))[1]
            values += step
            total += step[cbins[i], cbins[j]]
    return Model(base, cuts, tables, pairs)


# --------------------------------------------------------------------------- on DataFrames


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fits on at most TRAINING_ROWS labelled rows; only their measurements come to the driver."""
    known = labels.select(labels[id_col].alias("i"), labels[label_col].cast("double").alias("y")).dropna().filter(~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.round(F.avg("y")).alias("y")).orderBy(F.xxhash64("i"), "i").limit(TRAINING_ROWS)
    texts = docs.select(docs[id_col].alias("i"), text_of(docs, text_col).alias("t"))
    rows = texts.join(F.broadcast(known), "i")  # TRAINING_ROWS rows at most

    def values(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "y": pdf["y"], "x": list(measure_all(pdf["t"]))})

    kind = rows.schema["i"].dataType.simpleString()
    sample = rows.mapInPandas(values, f"i {kind}, y double, x array<double>")
    sample = sample.groupBy("i").agg(F.min(F.struct("x", "y")).alias("r")).select("i", "r.*").toPandas().sort_values("i")
    return fit(np.array(sample["x"].tolist()).reshape(-1, len(FEATURES)), sample["y"].to_numpy())


def score(docs: DataFrame, model: Model | None, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of docs and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = measure_all(t or "" for t in batch.column(place).to_pylist())
            scores = model.score(x) if model else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(rate, StructType([*docs.schema.fields, StructField(out_col, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    texts = docs.select("doc_id", "text")
    model = train(texts, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(measure_all(pdf["t"])) if model else np.ones(len(pdf))})

    scored = texts.select("doc_id", text_of(texts).alias("t")).mapInPandas(rate, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that score THRESHOLD or more, with their own columns."""
    name = own_name(docs, "score")
    return score(docs, model, out_col=name).filter(F.col(name) >= THRESHOLD).drop(name)
