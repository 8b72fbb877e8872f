"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``measure`` computes every measurement of a whole text once, ``ledger`` turns them into one
failure bit per rule, ``apply_policy`` decides with a versioned mask, ``ablation`` counts from
the stored bits what each rule rejects alone and together with the others. Changing a policy
needs neither the texts nor a second measurement.

Defined results: a null or empty text has no words and fails ``few_words``; a null doc_id is
carried through; repeated rows give repeated results; other columns of the input are ignored
by ``measure`` unless named in ``keep``; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import SPACES, let, text_of

WINDOW = 5

#: Rules in bit order: name and failing condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("shouting", "n_words >= 10 and 100 * n_upper > 60 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_words")),
    "v1": Policy("v1", tuple(name for name, _ in RULES)),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice, by sorting (hash, place)."""

    def places(pairs: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        return F.array_sort(
            F.transform(
                F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1))),
                lambda x: x["i"],
            )
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return let(pairs, lambda s: F.aggregate(places(s), start, step, lambda a: a["n"]))


def _repeat_words(words: Column) -> Column:
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(found)


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, the kept columns and the measurements (long)."""
    text = text_of(docs, text_col)
    words = F.array_remove(F.split(text, SPACES), "")
    by_words = let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    kept = [c for c in keep if c != id_col]
    rows = docs.select(docs[id_col], *[docs[c] for c in kept], by_words.alias("_w"), by_lines.alias("_l"), count(r"[#*$%&|<>]+").alias("_s"), count(r"\p{Lu}+").alias("_u"))
    at = {"n_lines": "_l.n_lines", "n_dup_lines": "_l.n_dup_lines", "n_symbols": "_s", "n_upper": "_u"}
    return rows.select(id_col, *kept, *[F.col(at.get(m, f"_w.{m}")).cast("long").alias(m) for m in MEASURES])


def ledger(measured: DataFrame) -> DataFrame:
    """Adds fail_bits: bit i is set if rule i fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, cond) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total.cast("long"))


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """Adds base_failed, kept and policy; only bits are read. kept is false wherever base_failed."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return book.withColumns(
        {"base_failed": failed(BASE), "kept": ~failed(policy.mask | BASE), "policy": F.lit(policy.version)}
    )


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents it fails, and those that only it fails (kept without it)."""
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(total(hit).alias("fails"), total(F.col("bits") == F.col("bit")).alias("fails_alone"))


def quality_rules(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    return apply_policy(ledger(measure(docs)), policy)


def keep_passing(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The documents that the policy keeps, with their own columns; decided in place, without a join."""
    cols = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in cols]).alias("_row"), text_of(docs).alias("text"))
    judged = apply_policy(ledger(measure(row, id_col="_row")), policy)
    return judged.filter("kept").select(*[F.col("_row")[c].alias(c) for c in cols])
