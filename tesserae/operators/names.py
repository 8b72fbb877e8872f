"""Names that are in other names, or close to them, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the longest gram by which a name is looked for inside others.
GRAM = 3
#: The ratio (twice the matched letters by all letters) from which names are close.
CLOSE = 0.90


def _grams(text: Column, n: int) -> Column:
    """All runs of n letters, in order; none of a shorter text."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(text, i, F.lit(n)))


def inside(texts: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Distinct pairs (text, name) where the name, which is not empty, stands in the text.

    A name is filed under its rarest gram of GRAM letters (a shorter name under itself), with the gram's place. A text
    asks for each of its grams, of GRAM letters and fewer: rows in proportion to its length, whose hits are verified.
    """
    own = names.select(F.col(name).alias("name")).filter("name <> ''").distinct()
    anchor = F.when(F.length("name") < GRAM, F.array("name")).otherwise(_grams(F.col("name"), GRAM))
    filed = own.select("name", F.posexplode(anchor).alias("at", "gram"))
    often = filed.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = filed.join(often, "gram").groupBy("name").agg(F.min(F.struct("n", "at", "gram")).alias("a")).select("name", "a.at", "a.gram")
    asking = texts.select(F.col(text).alias("text")).filter("text <> ''").distinct()
    grams = F.flatten(F.array(*[F.transform(_grams(F.col("text"), n), lambda g, i: F.struct(i.alias("i"), g.alias("gram"))) for n in range(1, GRAM + 1)]))
    met = asking.select("text", F.explode(grams).alias("g")).select("text", "g.i", "g.gram").join(rarest, "gram")
    begins = F.col("i") - F.col("at") + 1
    return met.filter((begins > 0) & (F.substr("text", F.greatest(begins, F.lit(1)), F.length("name")) == F.col("name"))).select("text", "name").distinct()


def _marked(text: Column) -> Column:
    """Pairs of letters, each with its number among equal ones; a text of one letter is its own pair."""
    pairs = F.when(F.length(text) < 2, F.array(text)).otherwise(_grams(text, 2))
    return F.transform(pairs, lambda g, i: F.concat(g, F.lit("\0"), F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def close_candidates(texts: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Distinct pairs (text, name), all that have a ratio of CLOSE or more among them, and few others.

    With M matched letters, 2M >= CLOSE (a + b) for lengths a and b. So b lies between a * CLOSE / (2 - CLOSE) and the reverse. A letter that one side lacks takes two pairs of letters from the
    other, and one that stands in between takes one: of a text of a letters at most 4 (1 - CLOSE) / (2 - CLOSE) * a pairs are without a partner. If one more
    than that are taken from each side, the rarest first, close names have one in common.
    """
    lost = 4 * (1 - CLOSE) / (2 - CLOSE)
    side = lambda df, c: df.select(F.col(c).alias("x")).filter("x <> ''").distinct().select("x", F.explode(_marked(F.col("x"))).alias("gram"))
    filed, asking = side(names, name), side(texts, text)
    often = filed.groupBy("gram").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, to: str) -> DataFrame:
        ranked = rows.join(often, "gram", "left").groupBy("x").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))  # of one name
        taken = F.slice("g", F.lit(1), F.floor(F.length("x") * lost + 1e-9).cast("int") + 1)
        return ranked.select(F.col("x").alias(to), F.explode(taken).alias("g")).select(to, "g.gram")

    met = rarest(asking, "text").join(rarest(filed, "name"), "gram").select("text", "name")
    a, b = F.length("text"), F.length("name")
    return met.filter(2 * F.least(a, b) + 1e-9 >= CLOSE * (a + b)).distinct()
