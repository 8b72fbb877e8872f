"""Connected components of a graph of long ids, by contraction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import staged


class Forest:
    """Union-find over any hashable nodes; the root of a tree is the node that comes first by ``rank``."""

    def __init__(self) -> None:
        self._up: dict = {}

    def find(self, x):
        up = self._up
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    def union(self, x, y, rank=lambda v: v) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            low, high = (x, y) if rank(x) < rank(y) else (y, x)
            self._up[high] = low
        return x != y

    def stars(self) -> Iterable[tuple]:
        """(root, node) of every node that isn't a root."""
        return ((self.find(x), x) for x in list(self._up) if self._up[x] != x)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, label): nodes have equal labels if and only if they are connected. A label is a node.

    A round sends each node to the first of itself and its neighbours in an order that is drawn anew for
    each round; edges follow their ends, and those that became loops or doubles go. So the graph shrinks by a constant
    factor a round, chains too. The first of a node's neighbours is combined before it is shuffled; joins have
    a row per edge that is left.
    """
    left = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for turn in range(1_000):
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)), F.col(c))
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select(F.col("b").alias("node"), F.col("a").alias("to")))
        first = ends.groupBy("node").agg(F.min_by("to", rank("to")).alias("to"))
        moves = staged(first.select("node", F.when(rank("to") < rank("node"), F.col("to")).otherwise(F.col("node")).alias("to")), "moves")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("label"))
        else:
            labels = labels.join(moves.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = staged(labels, "labels")
        at = lambda c: moves.select(F.col("node").alias(c), F.col("to").alias(f"new_{c}"))
        moved = left.join(at("a"), "a").join(at("b"), "b").filter("new_a <> new_b")
        left = staged(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "edges")
        if not left.limit(1).count():
            return labels
    raise RuntimeError("the graph did not shrink")
