"""Near-duplicates by an LSH forest: sorted signature orders, exact confirmation, components.

1. Every text gets its set of five-word shingles, a fingerprint of that set and a MinHash
   signature. Texts with equal sets are one class from there on.
2. The forest has a number of orders that follows from the similarity asked for (``Rule``). In
   each, classes are sorted by their own ``DEPTH`` signature values; the sort is by range over
   (values, class), so a crowded region spreads over partitions. Candidates of a class are its neighbour
   and the heads of its regions at depths ``BASE_DEPTH`` to ``DEPTH``: crowded regions are thus split
   deeper. Signatures travel along, and candidates whose whole signatures agree on fewer than the rule's
   ``least`` values go at once. The rest connects classes into families; a task gives a spanning forest of them.
3. All pairs inside a family are weighed, whether they met in the forest or
   not: a family of bounded size inside one task, a larger one by a hub that most of it links to,
   then blocks of what the hub misses against blocks of the whole. Links are confirmed on full sets.
4. Components of links give the smallest doc_id that can be reached.

A pair at the threshold misses all prefixes of ``BASE_DEPTH`` with a chance of ``MISSED`` at most, and
agrees on too few values with a chance of ``UNLIKE`` at most, whatever the threshold.

Defined results: a null, empty or blank text has no shingles and is its own component; rows with a
null doc_id get the component of their text, if others share it; repeated rows get repeated results;
two texts under one doc_id are two nodes; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import staged, text_of
from tesserae.llm.components import Forest, components

SHINGLE = 5
LINK_PERCENT = 85
DEPTH, BASE_DEPTH = 6, 4
MISSED, UNLIKE = 7.5e-6, 2e-5
FAMILY_CLASSES, FAMILY_SHINGLES, BLOCK = 1_500, 3_000_000, 500
FILTER_BITS = 24

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


@dataclass(frozen=True)
class Rule:
    """What links two sets, and the forest that finds such pairs."""

    percent: int = LINK_PERCENT

    @cached_property
    def trees(self) -> int:
        return max(1, math.ceil(math.log(MISSED) / math.log1p(-((self.percent / 100) ** BASE_DEPTH)))) if self.percent < 100 else 1

    @property
    def values(self) -> int:
        return self.trees * DEPTH

    @cached_property
    def least(self) -> int:
        """The most values that a pair at the threshold agrees on with a chance of 1 - UNLIKE."""
        s, below, count = self.percent / 100, 0.0, 0
        while count < self.values:
            below += math.comb(self.values, count) * s**count * (1 - s) ** (self.values - count)
            if below > UNLIKE:
                break
            count += 1
        return count

    @cached_property
    def hashing(self) -> tuple[np.ndarray, np.ndarray]:
        """Factors and offsets of the signature's values."""
        random = np.random.RandomState(20)
        return random.randint(0, 2**63, self.values, dtype="u8") | np.uint64(1), random.randint(0, 2**63, self.values, dtype="u8")


# --------------------------------------------------------------------------- one text


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles, or of its fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, "u8")
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    size = min(SHINGLE, len(w))
    out = np.full(len(w) - size + 1, size, "u8")
    for k in range(size):
        out = (out ^ w[k : len(w) - size + 1 + k]) * _MUL
        out ^= out >> _MIX
    return np.unique(out)


def signature(hashes: np.ndarray, rule: Rule) -> np.ndarray:
    """Minima of 32-bit hashes, as many as the rule's values."""
    factors, offsets = rule.hashing
    least = np.full(rule.values, 2**32 - 1, "u8")
    for k in range(0, len(hashes), 2048):
        part = hashes[k : k + 2048]
        np.minimum(least, ((part[None] * factors[:, None] + offsets[:, None]) >> _MIX).min(1), out=least)
    return least.astype("u4")


def prefix_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each tree's prefixes, from BASE_DEPTH to DEPTH: trees x depths."""
    values = sig.reshape(-1, DEPTH).astype("u8")
    key, out = np.arange(len(values), dtype="u8"), []
    for d in range(DEPTH):
        key = (key ^ values[:, d]) * _MUL
        key ^= key >> _MIX
        if d + 1 >= BASE_DEPTH:
            out.append(key)
    return np.stack(out, 1).view("i8")


def _scattered(cls: int) -> tuple[int, int]:
    return (cls ^ cls >> 29) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, cls


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a and b| >= percent |a or b|, on sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def links(sets: list[np.ndarray], sigs: np.ndarray, left: range, right: range, rule: Rule) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between left and right places: pairs already connected aren't weighed again."""
    forest = Forest()
    sizes = np.array([len(s) for s in sets])
    lo, hi = right.start, right.stop
    for i in left:
        near = (sigs[lo:hi] == sigs[i]).sum(1)
        fit = (near >= rule.least) & (100 * np.minimum(sizes[lo:hi], sizes[i]) >= rule.percent * np.maximum(sizes[lo:hi], sizes[i]))
        found = np.flatnonzero(fit)
        for j in (found[np.argsort(-near[found], kind="stable")] + lo).tolist():
            if j != i and forest.find(i) != forest.find(j) and linked(sets[i], sets[j], rule.percent):
                forest.union(i, j)
                yield i, j


# --------------------------------------------------------------------------- on DataFrames


def _signed(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """i, cls (the set's fingerprint; null without words), n, keys, sig (a byte per value)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["i"], pdf["t"], strict=True):
                s = shingles(text)
                if not len(s):
                    out.append((i, None, 0, None, None))
                    continue
                sig = signature(s, rule)
                cls = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                out.append((i, cls, len(s), prefix_keys(sig).ravel(), sig.astype("u1").tobytes()))
            frame = pd.DataFrame(out, columns=["i", "cls", "n", "keys", "sig"])
            yield frame.astype({"cls": "Int64"}) if frame["cls"].isna().all() else frame.assign(cls=pd.array([x[1] for x in out], "Int64"))

    rows = docs.select(docs[id_col].alias("i"), text_of(docs, text_col).alias("t"))
    return staged(rows.mapInPandas(sign, f"i {kind}, cls long, n long, keys array<long>, sig binary"), "signed")


def _families(classes: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) that connect classes which met in the sorted orders and whose signatures agree.

    Signatures travel with the sort. A task keeps a forest of what it has seen and gives one star per tree
    of it, with the node that comes first in a fixed order as its centre: a crowded region gives the same stars in most
    orders, and no task gives more edges than it read classes.
    """
    depths = DEPTH - BASE_DEPTH + 1
    starts = F.transform(F.sequence(F.lit(0), F.lit(rule.trees - 1)), lambda t: F.slice("keys", t * depths + 1, depths))
    rows = classes.select("cls", "n", "sig", F.explode(starts).alias("k")).select(*[F.get("k", F.lit(d)).alias(f"k{d}") for d in range(depths)], "cls", "n", "sig")
    order = [f"k{d}" for d in range(depths)] + ["cls"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def meet(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        kept = None  # of the rows so far: the last one, and before it the heads of its regions
        for pdf in batches:
            if not len(pdf):
                continue
            keys, cls, n = pdf[order[:-1]].to_numpy(), pdf["cls"].to_numpy(), pdf["n"].to_numpy()
            sig = np.frombuffer(b"".join(pdf["sig"]), "u1").reshape(-1, rule.values)
            if kept is not None:
                keys, cls, n, sig = (np.concatenate([old, new]) for old, new in zip(kept, (keys, cls, n, sig), strict=True))
            before = 0 if kept is None else depths  # the first rows are heads from before, the one at this place is the last row
            place = np.arange(len(cls))
            pairs = [(place[before + 1 :], place[before:-1])]
            ends = []
            for d in range(depths):
                new = np.ones(len(cls), bool)
                new[before + 1 :] = (keys[before + 1 :, : d + 1] != keys[before:-1, : d + 1]).any(1)
                head = np.maximum.accumulate(np.where(new, place, 0))
                if kept is not None:  # the last row's region began before
                    old = head == before
                    head[old] = d
                pairs.append((place[before:], head[before:]))
                ends.append(head[-1])
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            a, b = a[cls[a] != cls[b]], b[cls[a] != cls[b]]
            same = (keys[a, 0] == keys[b, 0]) & (100 * np.minimum(n[a], n[b]) >= rule.percent * np.maximum(n[a], n[b]))
            a, b = a[same], b[same]
            for k in range(0, len(a), 4096):
                x, y = a[k : k + 4096], b[k : k + 4096]
                near = (sig[x] == sig[y]).sum(1) >= rule.least
                for u, v in zip(cls[x[near]].tolist(), cls[y[near]].tolist(), strict=True):
                    forest.union(u, v, _scattered)
            kept = tuple(v[[*ends, len(cls) - 1]] for v in (keys, cls, n, sig))
        yield pd.DataFrame(list(forest.stars()), columns=["a", "b"], dtype="i8")

    return spread.mapInPandas(meet, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, set) of the wanted classes (cls, rep), from the texts.

    A bit table of fixed size tells most other texts apart before they are cut into shingles.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    words = wanted.select(bit(F.col("rep")).alias("h")).selectExpr("cast(shiftright(h, 5) as int) as w", "shiftleft(1L, cast(h & 31 as int)) as m")
    words = words.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()  # 2 ** 19 rows at most
    table = np.zeros(1 << (FILTER_BITS - 5), "u8")
    table[words["w"].to_numpy("i8")] = words["m"].to_numpy("u8")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for pdf in batches:
            h = pdf["h"].to_numpy("i8")
            maybe = table[h >> 5] >> (h & 31).astype("u8") & np.uint64(1)
            out = []
            for text in pdf["t"][maybe.astype(bool)]:
                s = shingles(text)
                if len(s):
                    out.append((int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True), s.tobytes()))
            yield pd.DataFrame(out, columns=["cls", "set"])

    rows = docs.select(bit(docs[id_col]).alias("h"), text_of(docs, text_col).alias("t"))
    return rows.mapInPandas(cut, "cls long, set binary").join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def _grouped(rows: DataFrame, by: list[str], work, schema: str) -> DataFrame:
    """work(rows of one group) over groups of bounded size, many groups to a task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf[by].to_numpy()
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(pdf)]
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if held and (held[-1][by].iloc[-1].to_numpy() != key[a]).any():
                    out.append(work(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held.append(pdf.iloc[a:b])
            if out:
                yield pd.concat(out)
        if held:
            yield work(pd.concat(held))

    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def _weigh(pdf: pd.DataFrame, rule: Rule, left: int | None = None) -> pd.DataFrame:
    """Links among the rows, or of the first ``left`` rows with all."""
    sets = [np.frombuffer(s, "u8") for s in pdf["set"]]
    sigs = np.frombuffer(b"".join(pdf["sig"]), "u1").reshape(-1, rule.values)
    cls, n = pdf["cls"].to_numpy(), len(pdf)
    found = list(links(sets, sigs, range(n if left is None else left), range(n), rule))
    return pd.DataFrame({"a": [cls[i] for i, _ in found], "b": [cls[j] for _, j in found]}, dtype="i8")


def _large_links(members: DataFrame, rule: Rule) -> DataFrame:
    """Links in families (cls, family, set, sig) that are too large for a task."""
    at = members.select("cls", "family", "sig")
    # The signature that most members share, value by value; the member closest to it is the hub.
    bytes_of = F.transform(F.sequence(F.lit(1), F.lit(rule.values)), lambda p: F.conv(F.hex(F.substring("sig", p, 1)), 16, 10).cast("int"))
    values = at.select("cls", "family", F.posexplode(bytes_of).alias("p", "v"))
    counts = values.groupBy("family", "p", "v").agg(F.count("*").alias("c"))
    usual = counts.groupBy("family", "p").agg(F.max_by("v", F.struct("c", "v")).alias("v"))
    close = values.join(usual, ["family", "p", "v"]).groupBy("family", "cls").agg(F.count("*").alias("c"))
    hubs = close.groupBy("family").agg(F.max_by("cls", F.struct("c", "cls")).alias("hub"))
    hub_sets = members.join(hubs.select(F.col("hub").alias("cls")), "cls", "left_semi").select("family", F.col("cls").alias("hub"), F.col("set").alias("hub_set"))

    def try_hub(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = [linked(np.frombuffer(x, "u8"), np.frombuffer(y, "u8"), rule.percent) for x, y in zip(pdf["set"], pdf["hub_set"], strict=True)]
            yield pdf[["cls", "family", "hub"]].assign(hit=np.array(hit, bool))

    tried = members.select("cls", "family", "set").join(hub_sets, "family")
    tried = staged(tried.mapInPandas(try_hub, "cls long, family long, hub long, hit boolean"), "hubs")
    stars = tried.filter("hit and cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    # What the hub misses meets the whole family, block by block.
    rest = tried.filter("not hit and cls <> hub").select("cls", "family")
    count = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    missed = rest.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rest_blocks"))
    sizes = count.join(missed, "family")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(rest.select("cls"), "cls", "left_semi").join(sizes, "family")
    left = left.select("family", block("rest_blocks").alias("x"), every("blocks").alias("y"), F.lit(0).alias("side"), "cls", "set", "sig")
    right = members.join(sizes, "family").select("family", every("rest_blocks").alias("x"), block("blocks").alias("y"), F.lit(1).alias("side"), "cls", "set", "sig")

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side", kind="stable").drop_duplicates("cls")
        return _weigh(pdf, rule, int((pdf["side"] == 0).sum()))

    return stars.union(_grouped(left.union(right), ["family", "x", "y"], weigh, "a long, b long"))


def near_duplicates(docs: DataFrame, *, percent: int = LINK_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id_col, n_shingles, cls, component_id, kept; sets that share percent or more are linked."""
    rule = Rule(percent)
    signed = _signed(docs, id_col, text_col, rule)
    classes = signed.filter("cls is not null").groupBy("cls").agg(
        F.min("i").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")
    )
    classes = staged(classes, "classes")
    families = components(_families(classes, rule)).withColumnRenamed("node", "cls").withColumnRenamed("label", "family")
    wanted = classes.select("cls", "rep", "n", "sig").join(families, "cls")
    sized = wanted.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("all_n"))
    sized = sized.select("family", ((F.col("m") > FAMILY_CLASSES) | (F.col("all_n") > FAMILY_SHINGLES) & (F.col("m") > 2)).alias("large"))
    wanted = staged(wanted.join(sized, "family"), "families")
    members = staged(_sets(docs, wanted, id_col, text_col).join(wanted.select("cls", "family", "large", "sig"), "cls"), "sets")
    found = _grouped(members.filter("not large").select("family", "cls", "set", "sig"), ["family"], lambda pdf: _weigh(pdf, rule), "a long, b long")
    large = members.filter("large")
    if large.limit(1).count():
        found = found.union(_large_links(large, rule))
    labels = components(staged(found, "links"))
    least = labels.join(classes.select(F.col("cls").alias("node"), "rep"), "node").groupBy("label").agg(F.min("rep").alias("component"))
    of_class = labels.join(least, "label").select(F.col("node").alias("cls"), "component")
    # Classes of one document without a link speak for themselves; what is left is joined with the documents alone, so a large class can be split.
    reps = classes.select("cls", "rep", "copies").join(of_class, "cls", "left").filter("copies > 1 or component is not null")
    reps = staged(reps.select("cls", F.coalesce("component", "rep").alias("component")), "representatives")
    out = signed.select("i", "n", "cls").join(reps, "cls", "left")
    own = F.coalesce("component", "i")
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), "cls", own.alias("component_id"), F.coalesce(F.col("i") == own, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, *, percent: int = LINK_PERCENT) -> DataFrame:
    """docs without the documents that another one of their component stands for; rows without an id stay."""
    gone = near_duplicates(docs.select("doc_id", "text"), percent=percent).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
