"""Distances and scores of picture fingerprints, as expressions that stay in generated code.

Fingerprints are columns: dhash array<bigint> of four words, phash bigint, gray and tiles
array<double>, width and height int. Constants must equal the matching rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the matching rules.
CERTAIN_SCORE, REVIEW_SCORE, CERTAIN_MARGIN = 0.86, 0.62, 0.05
ASPECT_TOLERANCE, CHROMA_TOLERANCE, CHROMA_SCALE, CHROMA_MOST = 0.04, 4.0, 95.0, 0.32
SHORTLIST, REFINE_MARGIN, REFINE_SIZE, REFINE_GRID, REFINE_SCALE = 400, 0.04, 256, 32, 120.0
LARGER_RATIO, ORIGINAL_RATIO, MIRROR_CERTAIN, BURST_MARGIN, EXIF_LEAST = 1.3, 1.2, 0.97, 0.02, 0.45
CERTAIN, REVIEW, NOT_FOUND = "확실", "확인필요", "못찾음"
KEY_UID, KEY_SUBSEC, KEY_MODEL, KEY_TIME = "사진 고유 ID", "촬영시각+1/100초+기종", "촬영시각+기종", "촬영시각"
AS_IS, MIRRORED = "그대로", "좌우 반전"
FAR = 1_000_000


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words; FAR if a length differs or one is missing."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0), FAR).otherwise(bits)


def hamming_word(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), FAR).otherwise(F.bit_count(a.bitwiseXOR(b)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    return _sum(values) / F.size(values)


def ncc(a: Column, b: Column) -> Column:
    """Normalised correlation without means; 0 where one side is flat."""

    def of(ma: Column, mb: Column) -> Column:
        dot = _sum(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
        na = F.sqrt(_sum(F.transform(a, lambda x: (x - ma) * (x - ma))))
        nb = F.sqrt(_sum(F.transform(b, lambda y: (y - mb) * (y - mb))))
        return F.when((na < 1e-6) | (nb < 1e-6), 0.0).otherwise(dot / (na * nb))

    means = F.array(F.struct(mean(a).alias("a"), mean(b).alias("b")))
    return F.get(F.transform(means, lambda m: of(m["a"], m["b"])), F.lit(0))


def tile_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference."""
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chroma(tiles: Column) -> Column:
    """Mean over tiles of the largest minus the smallest of red, green and blue."""
    n = (F.size(tiles) / 3).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_max(F.slice(tiles, i * 3 + 1, 3)) - F.array_min(F.slice(tiles, i * 3 + 1, 3)))
    return mean(each)


def aspect_gap(a: Column, b: Column) -> Column:
    """|ln(a / b)|, 1 if a ratio isn't positive."""
    return F.when((a > 0) & (b > 0), F.abs(F.log(a / b))).otherwise(1.0)


def match_score(ncc: Column, dhash: Column, phash: Column, tiles: Column, chroma_gap: Column, aspect: Column, same_size: Column) -> Column:
    """Weighted likeness in [0, 1], lowered where colour or shape differ, raised where a noted size is equal."""
    part = lambda x: F.greatest(F.lit(0.0), x)
    alike = 0.40 * part(ncc) + 0.20 * part(1 - dhash / 256.0) + 0.10 * part(1 - phash / 64.0) + 0.30 * part(1 - tiles / 80.0)
    pale = F.when(chroma_gap > CHROMA_TOLERANCE, F.least(F.lit(CHROMA_MOST), chroma_gap / CHROMA_SCALE)).otherwise(0.0)
    sized = F.when(same_size, F.least(F.lit(1.0), alike - pale + 0.06)).otherwise(alike - pale)
    cut = F.when(aspect > ASPECT_TOLERANCE, F.least(F.lit(0.25), (aspect - ASPECT_TOLERANCE) * 1.2)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sized - cut))


def capture_conflict(a_time: Column, b_time: Column, a_sub: Column, b_sub: Column) -> Column:
    """Whether both sides name a capture time and the times, or the fractions of one second, differ."""
    known = lambda x: F.coalesce(x, F.lit("")) != ""
    fractions = known(a_sub) & known(b_sub) & (F.coalesce(a_sub, F.lit("")) != F.coalesce(b_sub, F.lit("")))
    return known(a_time) & known(b_time) & ((F.coalesce(a_time, F.lit("")) != F.coalesce(b_time, F.lit(""))) | fractions)


def exif_keys(uid: Column, time: Column, subsec: Column, model: Column) -> Column:
    """array<struct<tier, name, key>> from the strongest key down."""
    known = lambda x: F.coalesce(x, F.lit("")) != ""
    key = lambda tier, name, when, value: F.when(when, F.struct(F.lit(tier).alias("tier"), F.lit(name).alias("name"), value.alias("key")))
    every = F.array(
        key(0, KEY_UID, known(uid), uid),
        key(1, KEY_SUBSEC, known(time) & known(model) & known(subsec), F.concat_ws("|", time, subsec, model)),
        key(2, KEY_MODEL, known(time) & known(model), F.concat_ws("|", time, model)),
        key(3, KEY_TIME, known(time), time),
    )
    return F.filter(every, lambda k: k.isNotNull())


def same_photo(a: str, b: str) -> Column:
    """Whether records in struct columns a and b are versions of one photo; cheap tests first."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    text = lambda c: F.coalesce(c, F.lit(""))
    fractions_differ = (text(x("subsec")) != "") & (text(y("subsec")) != "") & (text(x("subsec")) != text(y("subsec")))
    return (
        F.when(x("path") == y("path"), True)
        .when((text(x("unique_id")) != "") & (text(x("unique_id")) == text(y("unique_id"))), True)
        .when((text(x("taken_at")) != "") & (text(x("taken_at")) == text(y("taken_at"))) & (text(x("model")) == text(y("model"))), ~fractions_differ)
        .when(x("gray").isNull() | y("gray").isNull(), False)
        .when(aspect_gap(x("width") / x("height"), y("width") / y("height")) > 0.02, False)
        .when(hamming(x("dhash"), y("dhash")) > 16, False)
        .when(tile_distance(x("tiles"), y("tiles")) > 10, False)
        .otherwise(ncc(x("gray"), y("gray")) > 0.97)
    )


def local_peak(a: Column, b: Column, side: int, grid: int, channels: int) -> Column:
    """The greatest mean absolute difference of a patch: pictures of side x side pixels, row by row, cut into grid x grid patches."""
    step = side // grid

    def of(gap: Column) -> Column:
        first = lambda p, r: ((F.floor(p / grid) * step + r) * side + p % grid * step) * channels + 1
        line = lambda p, r: _sum(F.slice(gap, first(p, r).cast("int"), F.lit(step * channels)))
        lines = F.sequence(F.lit(0), F.lit(step - 1))
        patch = lambda p: F.aggregate(lines, F.lit(0.0), lambda s, r: s + line(p, r)) / float(step * step * channels)
        return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), patch))

    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.get(F.transform(F.array(gap), of), F.lit(0))


def refined_score(score: Column, a: Column, b: Column, side: int, grid: int, channels: int) -> Column:
    """The score after comparing two pictures pixel by pixel: correlation less the worst patch."""

    def grey(pixels: Column) -> Column:
        at = lambda i: _sum(F.transform(F.slice(pixels, (i * channels + 1).cast("int"), F.lit(channels)), lambda v: v.cast("double"))) / float(channels)
        return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), at)

    both = F.array(F.struct(grey(a).alias("a"), grey(b).alias("b")))
    alike = F.get(F.transform(both, lambda x: ncc(x["a"], x["b"])), F.lit(0))
    worst = F.least(F.lit(0.40), local_peak(a, b, side, grid, channels) / REFINE_SCALE)
    return 0.30 * score + 0.70 * F.greatest(F.lit(0.0), alike - worst)
