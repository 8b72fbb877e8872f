"""Line deduplication by a deletion-neighbourhood join over words.

Two lines match if they are equal, or if leaving out at most one word of each makes them equal (one edit per
``MIN_NEAR`` words, so shorter lines match only if they are equal). Every line with a word is compared. A line goes
if it matches an earlier one, in the order of (doc_id, line number). Words end at ASCII white space; letters of
scripts that are written without spaces are a word each.

Equal lines meet by a hash of their words. For near lines, every variant with at most one word left
out is a hashed key, and lines that share a key match; each is linked to the earliest line of a
key, and the link's texts are verified. Before that, a filter without losses finds the lines that can have a
partner: of two matching lines, each has at most one word that the other lacks, so the ``FEW`` words of smallest hash
that both have are among the ``FEW + 1`` smallest of either; all choices of ``FEW`` of these are keys, and only lines
that share one emit variants. All groups are combined before they are shuffled (a key's least and greatest line), so
a line that a third of all documents holds is no hot group, and no pair is ever expanded.

A single word decides little in a long line, but it can be the one that matters (a date, a name): what is a
near copy here may be a fact of its own there. ``near=False`` takes out equal lines alone.

Defined results: a null text stays null; empty texts and lines stay; documents with a null doc_id
are left as they are; repeated rows lose the same lines, and their own lines don't count as
earlier; n_chars follows the text where there is such a column; an empty table stays empty; all
other columns come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.bpe import by_bytes
from tesserae.llm.common import own_name, staged, text_of

MIN_WORDS, MIN_NEAR = 1, 8
FEW, ENOUGH = 5, 16
FILTER_BITS = 26
SLICE_BYTES, WINDOW = 1 << 20, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_MUL, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
# Blocks of scripts without spaces between words (Thai, Lao, Burmese, Khmer, Han, kana and what lies with them).
_SPACELESS = r"[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]"


def _mixed(x: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    for y in more:
        x = (x ^ np.asarray(y).astype("u8")) * _MUL
        x = x ^ (x >> _SHIFT)
    return x


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


_tables: dict[int, np.ndarray] = {}


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; a worker remembers the longest so far."""
    if base not in _tables or len(_tables[base]) < n:
        out = np.full(max(n, 1024), base, "u8")
        out[0] = 1
        _tables[base] = np.multiply.accumulate(out)
    return _tables[base][:n]


def deletions(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences end to end: each one's hash, and for each element the hash of its sequence without it.

    A hash is a sum of elements times powers of an odd base, modulo 2 ** 64; leaving one out divides
    what follows it by the base.
    """
    ends = _ends(counts)
    place = np.arange(len(hashes)) - np.repeat(ends[:-1], counts)
    terms = hashes * _powers(int(counts.max(initial=0)))[place]
    run = np.concatenate([np.zeros(1, "u8"), np.cumsum(terms, dtype="u8")])
    whole = run[ends[1:]] - run[ends[:-1]]
    before = run[:-1] - np.repeat(run[ends[:-1]], counts)
    after = np.repeat(whole, counts) - before - terms
    return whole, before + after * _BASE_INVERSE


# --------------------------------------------------------------------------- words and lines of many texts


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins and the last one ends."""
    offsets = np.frombuffer(texts.buffers()[1], "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    data = texts.buffers()[2]
    data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words of data: polynomials of their bytes, from sums over windows of words; a word as long as a window is hashed by itself."""
    out = np.zeros(len(starts), "u8")
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + WINDOW, side="right"))
        if to <= at:
            out[at] = xxhash.xxh3_64_intdigest(data[starts[at] : ends[at]].tobytes())
            at += 1
            continue
        base = starts[at]
        part = data[base : ends[to - 1]].astype("u8") + np.uint64(1)
        run = np.concatenate([np.zeros(1, "u8"), np.cumsum(part * _powers(len(part)), dtype="u8")])
        out[at:to] = (run[ends[at:to] - base] - run[starts[at:to] - base]) * _powers(len(part), int(_BASE_INVERSE))[starts[at:to] - base]
        at = to
    return _mixed(out, ends - starts)


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lines with a word, end to end; and of each such line the number of its words, its text and its number there."""
    if pc.any(pc.match_substring_regex(texts, _SPACELESS)).as_py():
        texts = pc.replace_substring_regex(texts, f"({_SPACELESS})", r" \1 ")
    data, offsets = _bytes_of(texts)
    blank = _BLANK[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:], last[:-1] = blank[:-1], blank[1:]
    first[offsets[offsets < len(data)]] = True
    last[offsets[offsets > 0] - 1] = True
    starts, ends = np.flatnonzero(first & ~blank), np.flatnonzero(last & ~blank) + 1
    breaks = np.flatnonzero(data == 10)
    n_lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    text = np.repeat(np.arange(len(texts)), n_lines)
    number = np.arange(len(text)) - np.repeat(_ends(n_lines)[:-1], n_lines)
    some = counts > 0
    return _word_hashes(data, starts, ends), counts[some], text[some], number[some]


def line_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = _ends(counts)
    place = np.arange(len(hashes)) - np.repeat(ends[:-1], counts)
    run = np.concatenate([np.zeros(1, "u8"), np.cumsum(hashes * _powers(int(counts.max(initial=0)))[place], dtype="u8")])
    return _mixed(run[ends[1:]] - run[ends[:-1]], counts).view("i8")


def sample_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers and keys: all choices of FEW among the FEW + 1 smallest distinct words of each line, and all words where they are no more than FEW."""
    owner = np.repeat(np.arange(len(counts)), counts)
    # About ENOUGH words of a line lie under its bound; lines that don't have enough distinct ones there look at all.
    bound = np.where(counts > ENOUGH, (2.0**64 / np.maximum(counts, 1)) * ENOUGH, 2.0**64 - 2048).astype("u8")
    low, who = _smallest(hashes, owner, hashes <= bound[owner])
    short = (np.bincount(who, minlength=len(counts)) <= FEW) & (counts > ENOUGH)
    if short.any():
        more, more_who = _smallest(hashes, owner, short[owner])
        keep = ~short[who]
        low, who = np.concatenate([low[keep], more]), np.concatenate([who[keep], more_who])
        order = np.argsort(who, kind="stable")
        low, who = low[order], who[order]
    n = np.bincount(who, minlength=len(counts))
    lines = np.flatnonzero(n)
    whole, less = deletions(low, n[lines])
    few = n[lines] <= FEW
    out_lines = np.concatenate([lines[few], who])
    return out_lines, np.concatenate([_mixed(whole[few], n[lines][few]), _mixed(less, n[who] - 1)]).view("i8")


def _smallest(hashes: np.ndarray, owner: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The FEW + 1 smallest distinct chosen hashes of each owner, ascending, and their owners."""
    h, who = hashes[chosen], owner[chosen]
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[new], who[new]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    return h[place <= FEW], who[place <= FEW]


def variants(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers and hashes of the lines and of all lines with one word less."""
    whole, less = deletions(hashes, counts)
    who = np.arange(len(counts))
    return np.concatenate([who, np.repeat(who, counts)]), np.concatenate([_mixed(whole, counts), _mixed(less, np.repeat(counts, counts) - 1)]).view("i8")


def match(a: list[str], b: list[str]) -> bool:
    """Whether leaving out at most one word of each makes a and b equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) == len(b):  # each loses a word: at either end of the span in which they differ
        return x[1:] == y[:-1] or x[:-1] == y[1:] or len(x) == 1
    longer, shorter = (x, y) if len(x) > len(y) else (y, x)
    return longer[1:] == shorter or longer[:-1] == shorter


def _units(texts: pa.Array) -> list[list[str]]:
    """Words of lines, as lines_of cuts them."""
    return [x.encode("utf-8", "surrogatepass").split() for x in pc.replace_substring_regex(texts, f"({_SPACELESS})", r" \1 ").to_pylist()]


def _lists(numbers: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """values grouped by ascending number, a list each for 0 ... n - 1."""
    order = np.argsort(numbers, kind="stable")
    offsets = np.searchsorted(numbers[order], np.arange(n + 1)).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order]))


# --------------------------------------------------------------------------- on DataFrames


def _lines(docs: DataFrame) -> DataFrame:
    """(d, th, line, h, keys): every line with a word; keys are empty for lines that are too short to be near another."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("d"), text_of(docs).alias("t")).withColumn("th", F.xxhash64("t"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t")
            for a, b in by_bytes(texts, SLICE_BYTES):
                hashes, counts, text, number = lines_of(texts[a:b])
                long = counts >= MIN_NEAR
                who, keys = sample_keys(hashes[np.repeat(long, counts)], counts[long])
                at = pa.array(text)
                columns = [batch.column("d")[a:b].take(at), batch.column("th")[a:b].take(at), pa.array(number.astype("i4")), pa.array(line_hashes(hashes, counts))]
                yield pa.RecordBatch.from_arrays([*columns, _lists(np.flatnonzero(long)[who], keys, len(counts))], names=["d", "th", "line", "h", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(rows.mapInArrow(cut, f"d {kind}, th long, line int, h long, keys array<long>"), "lines")


def _place() -> Column:
    return F.struct("d", "line")


def _bits(values: DataFrame, column: str, size: int) -> np.ndarray:
    """A table of size bits with those at the column's values modulo size set; size / 32 rows at most come to the driver."""
    at = values.select(F.pmod(F.col(column), F.lit(size)).alias("b")).selectExpr("cast(shiftright(b, 5) as int) as w", "shiftleft(1L, cast(b & 31 as int)) as m")
    rows = at.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    table = np.zeros(size >> 5, "u4")
    table[rows["w"].to_numpy()] = rows["m"].to_numpy().astype("u4")
    return table


def _set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 5] >> (at & 31).astype("u4") & 1).astype(bool)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(o, h, text) of the wanted lines (o, h, d, line); o is their order.

    A bit table of fixed size over the lines' places spares most other lines a shuffle while it isn't full.
    """
    size = 1 << FILTER_BITS
    table = docs.sparkSession.sparkContext.broadcast(_bits(wanted.select(F.expr("xxhash64(d) + 7919L * line").alias("p")), "p", size))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t")
            for a, b in by_bytes(texts, SLICE_BYTES):
                data, offsets = _bytes_of(texts[a:b])
                breaks = np.flatnonzero(data == 10)
                n_lines = np.diff(np.searchsorted(breaks, offsets)) + 1
                text = np.repeat(np.arange(b - a), n_lines)
                number = np.arange(len(text)) - np.repeat(_ends(n_lines)[:-1], n_lines)
                begins, ends = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([offsets[1:], breaks]))
                with np.errstate(over="ignore"):
                    place = batch.column("hd")[a:b].to_numpy()[text] + 7919 * number
                hit = np.flatnonzero(_set(table.value, place % size))
                found = pa.array([data[i:j].tobytes() for i, j in zip(begins[hit].tolist(), ends[hit].tolist(), strict=True)], pa.binary()).cast(pa.string())
                columns = [batch.column("d")[a:b].take(pa.array(text[hit])), pa.array(number[hit].astype("i4")), found]
                yield pa.RecordBatch.from_arrays(columns, names=["d", "line", "text"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("d"), F.expr("xxhash64(doc_id)").alias("hd"), text_of(docs).alias("t"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(cut, f"d {kind}, line int, text string").join(wanted, ["d", "line"])

    def same(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # two texts may have one doc_id: the line must be the wanted one
            hashes, counts, at, _ = lines_of(batch.column("text"))
            own = np.zeros(batch.num_rows, "i8")
            own[at] = line_hashes(hashes, counts)
            yield batch.filter(pa.array(own == batch.column("h").to_numpy()))

    return found.select("o", "h", "text").mapInArrow(same, "o long, h long, text string").dropDuplicates(["o"])


def _variants(texts: DataFrame) -> DataFrame:
    """(v, o) of all variants."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column("text"), SLICE_BYTES):
                hashes, counts, at, _ = lines_of(batch.column("text")[a:b])
                number, value = variants(hashes, counts)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(batch.column("o")[a:b].to_numpy()[at[number]])], names=["v", "o"])

    return texts.select("o", "text").mapInArrow(cut, "v long, o long")


def _near_links(docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h, ep): near lines and the place of the earliest line that they match by a variant."""
    keyed = lines.select(F.explode("keys").alias("k"), "h")
    shared = staged(keyed.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("k"), "shared-keys")
    wanted = keyed.join(shared, "k", "left_semi").select("h").distinct()
    # Numbers that rise with the place stand for it from here on: they are narrow and ordered.
    ordered = firsts.join(wanted, "h", "left_semi").select("h", "p.*").orderBy("d", "line").withColumn("o", F.monotonically_increasing_id())
    wanted = staged(ordered, "near-lines")
    texts = staged(_texts(docs, wanted), "near-texts")
    made = _variants(texts)
    earliest = staged(made.groupBy("v").agg(F.min("o").alias("e"), F.max("o").alias("l")).filter("e < l").select("v", "e"), "earliest")
    pairs = made.join(earliest, "v").filter("e < o").groupBy("o").agg(F.min("e").alias("e"))
    both = pairs.join(texts.select("o", "h", "text"), "o").join(texts.select(F.col("o").alias("e"), F.col("text").alias("other")), "e")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(_units(batch.column("text")), _units(batch.column("other")), strict=True)
            yield batch.select(["h", "e"]).filter(pa.array([match(x, y) for x, y in sides], pa.bool_()))

    near = both.select("h", "e", "text", "other").mapInArrow(verify, "h long, e long")
    return near.join(wanted.select(F.col("o").alias("e"), _place().alias("ep")), "e").select("h", "ep")


def duplicate_lines(docs: DataFrame, near: bool = True) -> DataFrame:
    """(doc_id, th, line): the lines that go, th being xxhash64 of the document's text."""
    lines = _lines(docs)
    firsts = staged(lines.groupBy("h").agg(F.min(_place()).alias("p"), F.max(_place()).alias("last")), "first-lines")
    limits = firsts.select("h", F.col("p").alias("limit"), "last")
    if near:
        linked = firsts.join(_near_links(docs, lines, firsts), "h", "left")
        limits = linked.select("h", F.least("p", F.coalesce("ep", "p")).alias("limit"), "last")
    limits = staged(limits.filter("last > limit").select("h", "limit"), "limits")  # read as a table, so a common line's join can be split
    return lines.select("d", "th", "line", "h").join(limits, "h").filter(_place() > F.col("limit")).select(F.col("d").alias("doc_id"), "th", "line")


def _split(docs: DataFrame, lists: DataFrame, th: str) -> tuple[DataFrame, DataFrame]:
    """Documents that surely lose no line, which need no shuffle, and the rest, by a bit table over (doc_id, th)."""
    size = 1 << FILTER_BITS
    at = "xxhash64(doc_id, `{}`)"
    table = docs.sparkSession.sparkContext.broadcast(_bits(lists.select(F.expr(at.format("th")).alias("p")), "p", size))
    name = own_name(docs, "_at")
    marked = docs.withColumn(name, F.expr(at.format(th)))

    def part(wanted: bool) -> DataFrame:
        def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = _set(table.value, batch.column(name).to_numpy() % size)
                yield batch.filter(pa.array(hit if wanted else ~hit))

        return marked.mapInArrow(keep, marked.schema).drop(name)

    return part(False), part(True)


def drop_duplicate_lines(docs: DataFrame, removed: str | None = None, near: bool = True) -> DataFrame:
    """docs with the earlier-seen lines taken out of text; removed names a column for their number."""
    th, gone = own_name(docs, "_th"), own_name(docs, "_gone")
    lists = duplicate_lines(docs, near).groupBy("doc_id", "th").agg(F.collect_set("line").alias(gone))  # a document's own lines
    lists = staged(lists, "gone-lines")
    whole, changed = _split(docs.withColumn(th, F.xxhash64(text_of(docs))), lists, th)
    joined = changed.join(lists.withColumnRenamed("th", th), ["doc_id", th], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    columns = [new[c].alias(c) if c in new else F.col(c) for c in docs.columns]
    count = F.coalesce(F.size(gone), F.lit(0)).cast("long")
    more = lambda c: [c.alias(removed)] if removed else []
    return whole.select(*docs.columns, *more(F.lit(0).cast("long"))).unionByName(joined.select(*columns, *more(count)))
