"""Windows, aggregates and set operations of the matching engine, over any tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_duplicates(df: DataFrame, group: list[str], name: str, order: list[str], out: str = "numbered") -> DataFrame:
    """name(1), name(2), ... for names that occur more than once in a group; single ones stay."""
    same = Window.partitionBy(*group, name)
    n, k = F.count("*").over(same), F.row_number().over(same.orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(name, F.lit("("), k.cast("string"), F.lit(")"))))


def running_number(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def ranked(df: DataFrame, query: str, order: list[Column], out: str = "rank") -> DataFrame:
    """order must end in a key, so that ranks don't depend on partitions."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def with_margin(df: DataFrame, query: str, score: str, rank: str = "rank", out: str = "margin") -> DataFrame:
    """score minus the next rank's score, or minus nothing where there is none."""
    after = F.lead(score, 1, 0.0).over(Window.partitionBy(query).orderBy(rank))
    return df.withColumn(out, F.col(score) - after)


def runners_up(df: DataFrame, query: str, rank: str, value: Column, first: int = 2, last: int = 4) -> DataFrame:
    """query, runners_up: values of ranks first to last, in order."""
    chosen = df.filter(F.col(rank).between(first, last))
    both = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v"))))
    return chosen.groupBy(query).agg(F.transform(both, lambda x: x["v"]).alias("runners_up"))


def best_variant(df: DataFrame, keys: list[str], variant: str, distance: str, ordinal: str) -> DataFrame:
    """Least distance of each key and the first variant that has it."""
    return df.groupBy(*keys).agg(F.min(distance).alias(distance), F.min_by(variant, F.struct(distance, ordinal)).alias(variant))


def largest_version(df: DataFrame, group: list[str], area: Column, size: Column, key: str) -> DataFrame:
    """The row of each group with the largest area, then size, then smallest key."""
    w = Window.partitionBy(*group).orderBy(area.desc(), size.desc(), F.col(key))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def histogram(df: DataFrame, column: str, values: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """A row per value, zero where it doesn't occur; extra: conditions counted too."""
    extra = extra or {}
    counts = df.groupBy(column).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in extra.items()])
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(counts, column, "left").select(column, zero("n"), *[zero(k) for k in extra])


def multimap(df: DataFrame, key: str, value: str, least: int = 1) -> DataFrame:
    """A row per key and distinct value, with the number (n) of the key's values; keys with fewer than least go.

    Values stay rows, so a key that has most of them is no row of its own; its number is summed up before it is shuffled.
    """
    rows = df.select(key, value).filter(F.col(key).isNotNull() & F.col(value).isNotNull()).distinct()
    n = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return rows.join(n, key)


def first_value(df: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_value(df: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def direction_votes(votes: DataFrame, voter: list[str], band: list[str], direction: str, sides: tuple[str, str]) -> DataFrame:
    """Each band's winning side: voters that name exactly one side count; a tie has no winner (no row)."""
    keys = list(dict.fromkeys([*band, *voter]))
    sure = votes.groupBy(*keys).agg(F.collect_set(direction).alias("_d")).filter(F.size("_d") == 1)
    a, b = (F.count_if(F.get("_d", F.lit(0)) == s) for s in sides)
    tally = sure.groupBy(*band).agg(a.alias("_a"), b.alias("_b"))
    return tally.filter("_a <> _b").select(*band, F.when(F.col("_a") > F.col("_b"), sides[0]).otherwise(sides[1]).alias("winner"))


def neighbours(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Adds the previous and the next value in a group's order."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumns({f"prev_{value}": F.lag(value).over(w), f"next_{value}": F.lead(value).over(w)})


def refresh_stats(states: DataFrame, failed: Column | None = None, thumbed: Column | None = None) -> DataFrame:
    """One row of counts from a snapshot diff: total, new_read, reused, gone, failed, thumbed."""
    none = F.lit(False)
    n = lambda c: F.count_if(c).alias
    s = F.col("state")
    return states.agg(
        n(s != "gone")("total"), n(s.isin("new", "changed"))("new_read"), n(s == "same")("reused"), n(s == "gone")("gone"),
        n(failed if failed is not None else none)("failed"), n(thumbed if thumbed is not None else none)("thumbed"),
    )
