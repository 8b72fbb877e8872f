"""Assignments that have one result, found in rounds of windows: nothing is folded row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.stages import written

ROUNDS = 6  # of claims, from one dealing out and writing to the next


def best_pairs(pairs: DataFrame, left: list[str], right: list[str], order: list[Column], shared: str | None = None) -> DataFrame:
    """The pairs that going through them in order would take, each left and each right side once.

    order must end in a key. Where ``shared`` holds, a pair's right side may be taken by any number of left sides, and doesn't keep others from it. A pair
    that comes first for both of its sides is taken whatever else is; all such pairs are taken at once and leave with everything that
    meets them, and the next round does the same with the rest. Each round takes the first pair of all at least, and mostly nearly all of them.
    """
    common = F.col(shared) if shared else F.lit(False)
    rest = pairs.withColumn("_shared", common)
    by_left, by_right = Window.partitionBy(*left), Window.partitionBy("_shared", *right)
    taken = None
    while True:
        first = (F.row_number().over(by_left.orderBy(*order)) == 1) & (F.col("_shared") | (F.row_number().over(by_right.orderBy(*order)) == 1))
        marked = rest.withColumn("_first", first)
        gone = F.max("_first").over(by_left) | (F.max("_first").over(by_right) & ~F.col("_shared"))
        marked = written(marked.withColumn("_gone", gone), "pairs")
        chosen = marked.filter("_first").select(*pairs.columns)
        taken = chosen if taken is None else taken.unionByName(chosen)
        rest = marked.filter("not _gone").drop("_first", "_gone")
        if rest.isEmpty():
            return taken


def settle(claims: DataFrame, group: list[str], claimant: str, choices: str, rival: str, score: str) -> DataFrame:
    """claims with ``_at``: which of its choices (from 0) each claimant ends with, so that no two of a group have the same one.

    choices: an array of structs in the order of preference, of which ``rival`` names what is claimed and ``score`` ranks those who claim it;
    of equal scores the smaller claimant keeps it. Who is outranked claims the next choice, and may outrank another there; rounds end when
    everybody holds something else, or has no choice left. Groups are dealt out once for ROUNDS rounds, whose windows all keep to that, and written after
    the last of them; only groups where somebody had to move in it go on.
    """
    now = F.get(choices, F.col("_at"))
    order = [now[score].desc_nulls_last(), F.col(claimant)]
    here = Window.partitionBy(*group, "_claimed")
    rest, done = claims.withColumn("_at", F.lit(0)), None
    while True:
        rows = rest.repartition(*group)
        for _ in range(ROUNDS):
            rows = rows.withColumn("_claimed", now[rival])
            rows = rows.withColumn("_lost", F.col("_claimed").isNotNull() & (F.row_number().over(here.orderBy(*order)) > 1))
            rows = rows.withColumn("_at", F.col("_at") + F.col("_lost").cast("int")).drop("_claimed")
        rows = written(rows.withColumn("_open", F.max("_lost").over(Window.partitionBy(*group))).drop("_lost"), "claims")
        settled = rows.filter("not _open").drop("_open")
        done = settled if done is None else done.unionByName(settled)
        rest = rows.filter("_open").drop("_open")
        if rest.isEmpty():
            return done
