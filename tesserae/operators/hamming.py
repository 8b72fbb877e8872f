"""Top-k search by Hamming distance through banded keys.

Codes are cut into m bands. Two codes whose bands differ by more than r_1, ..., r_m bits each differ by at least
sum(r_j + 1) bits, so all index rows within a distance of sum(r_j + 1) - 1 have a band j that lies within r_j of the query's. A
search joins equal bands first, then bands that differ by one bit, two, and so on: a query's keys of a round are its
bands with so many bits flipped. A query is settled once its k-th distance lies within what its rounds have covered;
when that distance is known, the last round asks only the bands that are still missing.

Rounds pay while they weigh fewer rows than there are. By the number of rows and k, codes of even bits would have
their k-th neighbour at a distance that a binomial quantile gives; where the rounds up to it would weigh most of the index anyway,
or need too many keys, queries are weighed against all rows instead: in blocks of queries and
parts of the index that meet as cogroups of bounded size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.stages import written

#: Keys of one band in one round, at most; the share of the index that rounds may weigh.
MOST_KEYS = 5_000
MOST_WEIGHED = 0.3
FIRST_KEYS = 1_024  # of one band in the first round, which takes the small radii together
#: Queries and index rows of one cogroup, about.
QUERY_BLOCK, ROW_BLOCK = 1_024, 16_384


class Bands:
    """How codes are cut: m bands of width bits, none across words."""

    def __init__(self, words: int, word_bits: int, rows: int) -> None:
        wanted = min(word_bits, max(16, math.ceil(math.log2(max(rows, 2)))))
        self.per_word = max(1, word_bits // wanted)
        self.width = -(-word_bits // self.per_word)
        self.m = words * self.per_word
        self.bits = words * word_bits

    def keys(self, words: Column) -> Column:
        """The bands of a code, in order."""
        part = lambda j: F.shiftrightunsigned(F.get(words, F.lit(j // self.per_word)), j % self.per_word * self.width)
        return F.array(*[part(j).bitwiseAND(F.lit((1 << self.width) - 1)) for j in range(self.m)])

    def ring(self, r: int) -> int:
        return math.comb(self.width, r)

    def rounds(self, distance: int) -> int:
        """Rounds (radii 0, 1, ...) that prove a distance."""
        return -(-(distance + 1) // self.m)

    def weighed(self, distance: int) -> float:
        """The share of evenly distributed codes that the rounds up to a distance meet, at most."""
        full, more = divmod(distance + 1, self.m)
        share = lambda r: sum(self.ring(x) for x in range(min(r, self.width + 1))) / 2.0**self.width
        return (self.m - more) * share(full) + more * share(full + 1)

    def pays(self, distance: int) -> bool:
        return self.weighed(distance) <= MOST_WEIGHED and max(self.ring(min(r, self.width)) for r in range(self.rounds(distance))) <= MOST_KEYS

    def expected(self, rows: int, k: int) -> int:
        """The k-th least distance to so many codes of even bits."""
        below = 0
        for d in range(self.bits + 1):
            below += math.comb(self.bits, d)
            if rows * below >= k << self.bits:
                return d
        return self.bits


def top_k_hamming(
    queries: DataFrame, index: DataFrame, query_id: str, index_id: str, words: str, k: int, variant: str | None = None, *, word_bits: int = 64, work: dict[str, int] | None = None
) -> DataFrame:
    """The k index rows closest to each query by Hamming distance of words: array<bigint>, word_bits of each in use.

    Ties go to the smaller index_id. With variant, a query has several rows, and its best variant counts, the first in
    variant's order. Rows: query_id, index_id, distance, rank[, variant]. Rows without words are left out. work gets what was done:
    index rows met by rounds and by whole searches, and queries settled by rounds.
    """
    names = [variant] if variant else []
    asked = queries.filter(F.col(words).isNotNull()).select(F.col(query_id).alias("q"), (F.col(variant) if variant else F.lit(0)).alias("v"), F.col(words).alias("w"))
    rows = index.filter(F.col(words).isNotNull()).select(F.col(index_id).alias("i"), F.col(words).alias("x"))
    some, n = asked.select("w").first(), rows.count()
    kinds = {c: t for c, t in asked.dtypes + rows.dtypes}
    shape = f"q {kinds['q']}, i {kinds['i']}, distance long, v {kinds['v']}"
    done = None if work is None else {"banded": 0, "whole": 0, "settled": 0}
    found = queries.sparkSession.createDataFrame([], shape)
    if some is not None and n:
        bands = Bands(len(some.w), word_bits, n)
        left = asked
        if bands.pays(bands.expected(n, k)):
            found, left = _by_bands(asked, rows, k, bands, shape, done)
        if done is not None:
            waiting = left.select("q").distinct().count()
            done["whole"] = left.count() * n
            done["settled"] = asked.select("q").distinct().count() - waiting
        found = found.unionByName(_whole(left, rows, k, n, shape))
    if done is not None:
        work.update(done)
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "i"))).filter(F.col("rank") <= k)
    return out.select(F.col("q").alias(query_id), F.col("i").alias(index_id), "distance", *[F.col("v").alias(c) for c in names], "rank")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """Each query's k best of hits (q, i, distance, v), an index row once."""
    each = hits.groupBy("q", "i").agg(F.min("distance").alias("distance"), F.min_by("v", F.struct("distance", "v")).alias("v"))
    order = Window.partitionBy("q").orderBy("distance", "i")
    return each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def _by_bands(asked: DataFrame, rows: DataFrame, k: int, bands: Bands, shape: str, done: dict[str, int] | None) -> tuple[DataFrame, DataFrame]:
    """The results of queries that rounds settle, and the others as they were asked."""
    spark = asked.sparkSession
    keyed = written(rows.select("i", "x", F.posexplode(bands.keys(F.col("x"))).alias("band", "key")), "bands")
    open_ = written(asked.select("q", "v", "w", F.lit(bands.m).alias("ask")), "bands-asked")
    held, settled, left = spark.createDataFrame([], shape), spark.createDataFrame([], shape), asked.limit(0)
    far = F.aggregate(F.zip_with("w", "x", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b).cast("long")
    bound = max(d for d in range(bands.bits + 1) if bands.pays(d))  # the greatest distance that rounds may prove
    radius = max((r for r in range(bands.rounds(bound)) if sum(map(bands.ring, range(r + 1))) <= FIRST_KEYS), default=0)
    radii = range(radius + 1)  # small radii are one round
    while True:
        masks = [sum(1 << b for b in bits) for r in radii for bits in combinations(range(bands.width), r)]
        flips = F.expr(f"array({', '.join(f'{x}L' for x in masks)})")  # MOST_KEYS numbers, about
        probes = open_.select("*", F.posexplode(bands.keys(F.col("w"))).alias("band", "own")).filter("band < ask")
        probes = probes.select("q", "v", "w", "band", F.explode(F.transform(flips, lambda m: F.col("own").bitwiseXOR(m))).alias("key"))
        met = probes.hint("merge").join(keyed, ["band", "key"])  # keys are many times the rows that Spark sizes them by
        hits = met.filter(far <= bound).select("q", "i", far.alias("distance"), "v")  # what lies beyond is no result of a round
        if done is not None:
            done["banded"] += met.count()
        held = written(_best(held.join(open_.select("q").distinct(), "q", "left_semi").unionByName(hits), k), "bands-best")
        kth = held.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        status = open_.join(kth, "q", "left").withColumn("kth", F.when(F.col("n") >= k, F.col("kth")))
        ready = F.coalesce(F.col("kth") < bands.m * radius + F.col("ask"), F.lit(False))
        next_round = F.lit(bands.m * (radius + 2) - 1 <= bound) | F.coalesce(F.col("kth") <= bound, F.lit(False))  # a k-th distance only gets less
        status = status.withColumns({"ready": ready, "more": ~ready & next_round})
        settled = settled.unionByName(held.join(status.filter("ready").select("q").distinct(), "q", "left_semi"))
        left = left.unionByName(status.filter("not ready and not more").select("q", "v", "w"))
        radius += 1
        radii = (radius,)
        missing = F.least(F.lit(bands.m), F.coalesce(F.col("kth") + 1 - bands.m * radius, F.lit(bands.m))).cast("int")
        open_ = written(status.filter("more").select("q", "v", "w", missing.alias("ask")), "bands-asked")
        if open_.isEmpty():
            return settled, left


def _whole(asked: DataFrame, rows: DataFrame, k: int, n: int, shape: str) -> DataFrame:
    """Each query against every row: blocks of queries meet parts of the index in cogroups of bounded size."""
    blocks = -(-asked.count() // QUERY_BLOCK)
    parts = -(-n // ROW_BLOCK)
    if not blocks:
        return asked.sparkSession.createDataFrame([], shape)
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    a = asked.select("q", "v", "w", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).withColumn("part", every(parts))
    x = rows.select("i", "x", F.pmod(F.xxhash64("i"), F.lit(parts)).alias("part")).withColumn("block", every(blocks))

    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            ids = rows["i"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, code = ids[order], np.array(rows["x"].tolist(), "i8").view("u8")[order]
            for q, own in asked.sort_values("v").groupby("q", sort=False):
                each = np.array(own["w"].tolist(), "i8").view("u8")
                far = np.bitwise_count(each[:, None, :] ^ code[None]).sum(2, dtype="i8")
                turn = far.argmin(0)
                far = far.min(0)
                near = np.argsort(far, kind="stable")[:k]  # of equal distances the smaller id
                out.append(pd.DataFrame({"q": q, "i": ids[near], "distance": far[near], "v": own["v"].to_numpy()[turn[near]]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("q", "i", "distance", "v")})

    return a.groupBy("block", "part").cogroup(x.groupBy("block", "part")).applyInPandas(search, shape)
