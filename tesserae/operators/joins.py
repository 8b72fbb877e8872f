"""Join shapes of the matching engine, over any tables.

All are equi-joins or windows that Catalyst plans. The top-k search is in ``hamming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.hamming import top_k_hamming  # noqa: F401
from tesserae.operators.stages import written

#: Index rows of one key that one task joins, at most.
HOT_ROWS = 100_000
_ENDLESS, _SMALLEST = 9_999, -1_074  # levels of bands without an end, and of those whose width rounds to nothing


def first_tiers(queries: DataFrame, index: DataFrame, query_id: str, index_id: str, keys: str = "keys", other_than_self: bool = False) -> DataFrame:
    """Each query's keys of its first tier that the index has: query_id, key, tier, name, n (index rows with the key).

    Only the numbers of rows by key are joined, so no hit is made to find the tier.
    """
    q = queries.select(query_id, F.explode(keys).alias("k")).groupBy(query_id, F.col("k.key").alias("key")).agg(F.min(F.struct("k.tier", "k.name")).alias("k")).select(query_id, "key", "k.tier", "k.name")
    x = _keys_of(index, index_id, keys)
    known = q.join(x.groupBy("key").agg(F.count("*").alias("n")), "key")
    if other_than_self:
        own = x.join(q.select(F.col(query_id).alias(index_id), "key"), [index_id, "key"]).groupBy(F.col(index_id).alias(query_id), "key").agg(F.count("*").alias("own"))
        known = known.join(own, [query_id, "key"], "left").filter(F.col("n") > F.coalesce("own", F.lit(0))).drop("own")
    return known.withColumn("_first", F.min("tier").over(Window.partitionBy(query_id))).filter("tier = _first").drop("_first")


def _keys_of(index: DataFrame, index_id: str, keys: str) -> DataFrame:
    return index.select(index_id, F.explode(F.array_distinct(F.transform(keys, lambda k: k["key"]))).alias("key")).filter("key is not null")


def tiered_key_join(queries: DataFrame, index: DataFrame, query_id: str, index_id: str, keys: str = "keys", other_than_self: bool = False) -> DataFrame:
    """Hits of each query's first tier that has any. Both sides have keys: array<struct<tier, name, key>>.

    Rows: query_id, index_id, tier, name. A key matches across tiers by its text, as its name decides
    nothing; an index row counts once per query. other_than_self: equal ids are no hit. Key statistics decide the tier, and
    only its hits are made; a key that more than HOT_ROWS index rows have is split into parts by a hash of their ids.
    """
    chosen = first_tiers(queries, index, query_id, index_id, keys, other_than_self)
    parts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    hot = chosen.filter(F.col("n") > HOT_ROWS).select("key", parts.alias("parts")).distinct()
    x = _keys_of(index, index_id, keys).join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64(index_id), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    hits = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).join(x, ["key", "part"])
    if other_than_self:
        hits = hits.filter(F.col(query_id) != F.col(index_id))
    return hits.groupBy(query_id, index_id).agg(F.min("tier").alias("tier"), F.min("name").alias("name"))


def key_join(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """rows with every index row of an equal key. A key that more than HOT_ROWS index rows have is joined in parts by a hash of those rows."""
    sizes = index.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS)
    hot = sizes.select(key, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_parts"))  # one key in HOT_ROWS rows at most
    parts = F.coalesce("_parts", F.lit(1))
    dealt = index.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*index.columns), parts).cast("int")).drop("_parts")
    asked = rows.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return asked.join(dealt, [key, "_part"]).drop("_part")


def name_then_stem_join(queries: DataFrame, index: DataFrame, query_id: str, index_id: str, name: str, stem: str) -> DataFrame:
    """Index rows of equal name, or, for queries that have none, of equal stem. Both sides have both keys."""
    exact = key_join(queries.select(query_id, name), index.select(index_id, name), name).select(query_id, index_id)
    rest = queries.join(exact.select(query_id).distinct(), query_id, "left_anti")
    by_stem = key_join(rest.select(query_id, stem), index.select(index_id, stem), stem).select(query_id, index_id)
    return exact.withColumn("by", F.lit("name")).union(by_stem.withColumn("by", F.lit("stem")))


def candidate_union(query_id: str, index_id: str, **sources: DataFrame) -> DataFrame:
    """One row per (query, index row) over several sources, with a flag per source; names order precedence.

    origin is the first source, in the order given, that has the pair.
    """
    names = list(sources)
    tagged = [df.select(query_id, index_id, F.lit(i).alias("_at")) for i, df in enumerate(sources.values())]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    flags = [F.max((F.col("_at") == i)).alias(f"by_{n}") for i, n in enumerate(names)]
    first = F.get(F.array(*[F.lit(n) for n in names]), F.min("_at"))
    return both.groupBy(query_id, index_id).agg(*flags, first.alias("origin"))


def without(candidates: DataFrame, excluded: DataFrame, on: str | list[str]) -> DataFrame:
    """Candidates that are not excluded."""
    return candidates.join(excluded.select(on).distinct(), on, "left_anti")


def lookup(facts: DataFrame, dictionary: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """N:1 lookup; a dictionary that Spark finds small is broadcast, a larger one is not."""
    return facts.join(dictionary, on, how)


def interval_join(rows: DataFrame, bands: DataFrame, key: list[str], at: str, low: str, high: str) -> DataFrame:
    """rows with every band of their key that has low <= at < high; numbers, whole or not, of any size.

    A band as wide as 2^e, or less, lies in at most two cells of that width (three where its ends are rounded), and a row asks one cell of each
    width that bands have: an equality join, whose hits are verified. Widths are as many as binary exponents at most; bands without an end have
    one cell. Bands that are empty or have a null end meet nothing. at, low and high must not name columns of the other side.
    """
    number = lambda c: F.col(c).cast("double")
    width = number(high) - number(low)
    endless = (F.abs(width) > 1e300) | F.isnan(width)
    level = F.when(endless, F.lit(_ENDLESS)).when(width > 0, F.ceil(F.log2(width))).otherwise(_SMALLEST).cast("int")
    real = bands.filter(F.col(low) < F.col(high)).withColumn("_level", level)
    size = F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda c: F.when(F.col("_level") == _ENDLESS, F.lit(0).cast("long")).otherwise(F.floor(number(c) / size))
    covered = real.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    levels = sorted(r[0] for r in real.select("_level").distinct().collect())  # binary exponents
    asked = rows.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))).withColumn("_cell", cell(at))
    met = asked.join(covered, [*key, "_level", "_cell"]).filter((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high)))
    return met.drop("_level", "_cell")


def first_band(rows: DataFrame, bands: DataFrame, key: list[str], at: str, start: str, end: str, pick: str) -> DataFrame:
    """rows with the value ``pick`` of the first band (by start) of their key that covers ``at``; null without."""
    asked = rows.select(*key, at).distinct()
    met = interval_join(asked, bands.select(*key, F.col(start).alias("_s"), F.col(end).alias("_e"), pick), key, at, "_s", "_e")
    best = met.groupBy(*key, at).agg(F.min_by(pick, F.struct("_s", pick)).alias(pick))
    return rows.join(best, [*key, at], "left")


def as_of(rows: DataFrame, facts: DataFrame, key: list[str], at: str, take: list[str], *, ties: list[str] | None = None, after: bool = False, strict: bool = False) -> DataFrame:
    """rows with the columns ``take`` of the last fact of their key at or before ``at``, null without.

    after: the first one at or after it. strict: not one at the same place. Of facts at one place the last by ties counts (after: the first).
    Both sides go in one order and the last fact is carried along: linear, and nothing is collected per key. That order is cut into ranges, so a key that has most
    rows spreads; what a range begins with is carried from the ranges before it, a row per key and range.
    """
    ties = ties or []
    names = [f"_tie{n}" for n in range(len(ties))]
    kinds = {c: facts.schema[c].dataType for c in [*ties, *take]}
    fact = F.struct(*[F.col(c) for c in take])
    facts = facts.dropna(subset=[*key, at]).select(*key, at, F.lit(int(strict)).alias("_side"), *[F.col(c).alias(n) for c, n in zip(ties, names, strict=True)], fact.alias("_fact"))
    own = rows.select(*key, at, F.lit(1 - int(strict)).alias("_side"), *[F.lit(None).cast(kinds[c]).alias(n) for c, n in zip(ties, names, strict=True)], F.struct("*").alias("_row"))
    both = own.unionByName(facts, allowMissingColumns=True)
    turn = (lambda c: F.col(c).desc_nulls_first()) if after else (lambda c: F.col(c).asc_nulls_first())
    order = [turn(at), F.col("_side").asc(), *map(turn, names)]
    dealt = both.repartitionByRange(*key, *order, F.xxhash64("_row")).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "as-of")  # ranges stay as they are, whoever reads them again
    here = Window.partitionBy(*key, "_range").orderBy(*order)
    place = dealt.filter("_fact is not null").withColumn("_n", F.row_number().over(here))
    ends = place.groupBy(*key, "_range").agg(F.max_by("_fact", "_n").alias("_fact"))
    starts = dealt.select(*key, "_range").distinct().join(ends, [*key, "_range"], "left")
    carried = F.last("_fact", True).over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(*key, "_range", carried.alias("_carried"))
    seen = dealt.withColumn("_fact", F.last("_fact", True).over(here.rowsBetween(Window.unboundedPreceding, 0))).filter("_row is not null")
    out = seen.join(starts, [*key, "_range"], "left").select("_row.*", F.coalesce("_fact", "_carried").alias("_fact"))
    return out.select(*rows.columns, *[F.col("_fact")[c].alias(c) for c in take])


def snapshot_diff(known: DataFrame, current: DataFrame, key: str, same: Column) -> DataFrame:
    """Every key of either snapshot with its state: new, changed, same or gone.

    ``same`` compares the sides as k and c.
    """
    joined = known.alias("k").join(current.alias("c"), F.col(f"k.{key}") == F.col(f"c.{key}"), "full_outer")
    state = (
        F.when(F.col(f"k.{key}").isNull(), "new").when(F.col(f"c.{key}").isNull(), "gone").when(F.coalesce(same, F.lit(False)), "same").otherwise("changed")
    )
    return joined.select(F.coalesce(f"k.{key}", f"c.{key}").alias(key), state.alias("state"))


def cascade(wanted: DataFrame, key: str, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first step that answers a key wins. Steps give (key, answer, order); ties go to the least order.

    Rows: key, answer, how, others (further answers of that step, in order). Keys without answer have nulls.
    """
    every = None
    for n, (how, answers) in enumerate(steps):
        step = answers.select(key, "answer", F.col("order").cast("string").alias("order"), F.lit(n).alias("_n"), F.lit(how).alias("how"))
        every = step if every is None else every.unionByName(step)
    ranked = every.groupBy(key, "_n", "how").agg(F.sort_array(F.collect_set(F.struct("order", "answer"))).alias("_a"))
    best = ranked.groupBy(key).agg(F.min_by(F.struct("how", "_a"), "_n").alias("_b"))
    answers = F.col("_b._a")
    found = best.select(key, F.get(answers, F.lit(0))["answer"].alias("answer"), F.col("_b.how").alias("how"), F.transform(F.slice(answers, 2, 2), lambda a: a["answer"]).alias("others"))
    return wanted.select(key).distinct().join(found, key, "left")


def latest(corrections: DataFrame, on: list[str], order: str) -> DataFrame:
    """One row per key: the last."""
    w = Window.partitionBy(*on).orderBy(F.desc(order))
    return corrections.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def corrected(state: DataFrame, corrections: DataFrame, on: list[str], order: str) -> DataFrame:
    """state with the last correction of each key, null where there is none."""
    return state.join(latest(corrections, on, order), on, "left")
