"""Names of pictures from the tables around them.

Cells are rows: doc, section, table_order, cell_no, row, col, row_span, col_span, text, image_id (a
picture as the cell's background), inline_ids (pictures in the cell). Candidates, bands and votes
are joins and aggregates; cells are handed out by rounds of windows, best score first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import joins as J
from tesserae.operators import ranking as R
from tesserae.operators.assignment import best_pairs
from tesserae.operators.stages import written

# What each kind of place is worth as a picture's name.
OWN, EXACT, OVERLAP, HEADER = 170, 100, 45, 45
BELOW, ABOVE, SAME_BAND, OTHER_BAND, NO_PHOTO_ROW = 12, 8, 25, -35, 10
SINGLE_LINE, SHORT, COLON, ONE_LETTER, VOTE, ACCEPTED = 8, 6, -14, -20, 15, 55
SOURCES = {"own": "사진 칸 자체", "below": "아래 칸", "above": "위 칸", "header": "행 머리글"}
TABLE = ["doc", "section", "table_order"]
HOPS = 4


def _ready(cells: DataFrame) -> DataFrame:
    if "cell_no" not in cells.columns:
        cells = R.running_number(cells, TABLE, ["row", "col"], "cell_no")
    photo = F.col("image_id").isNotNull() | (F.size(F.coalesce("inline_ids", F.array().cast("array<int>"))) > 0)
    flat = T.normalize(F.col("text"))
    ends = {"row_end": F.col("row") + F.col("row_span"), "col_end": F.col("col") + F.col("col_span")}
    return cells.withColumns({"flat": flat, "is_photo": photo, **ends}).withColumn("named", T.is_caption_like(F.col("flat")))


def shape_bonus(text: Column) -> Column:
    return (
        F.when(text.contains("\n"), 0).otherwise(SINGLE_LINE)
        + F.when(F.length(text) <= 20, SHORT).otherwise(0)
        + F.when(text.rlike(r"[:：]\s*$"), COLON).otherwise(0)
        + F.when(F.length(text) == 1, ONE_LETTER).otherwise(0)
    )


def bands(ready: DataFrame) -> DataFrame:
    """TABLE, band_no, start, stop, header: rows under a caption-like cell of the first column, else the whole table."""
    own = ready.filter("col = 0 and not is_photo and named").select(*TABLE, F.col("cell_no").alias("band_no"), F.col("row").alias("start"), F.col("row_end").alias("stop"), F.col("flat").alias("header"))
    bare = ready.groupBy(*TABLE).agg(F.min("row").alias("start"), F.max("row_end").alias("stop")).join(own.select(*TABLE).distinct(), TABLE, "left_anti")
    return own.unionByName(bare.select(*TABLE, F.lit(0).cast("int").alias("band_no"), "start", "stop", F.lit("").alias("header")))


def with_band(rows: DataFrame, table_bands: DataFrame) -> DataFrame:
    """Adds band: struct of the first band that covers the row, or null."""
    whole = table_bands.withColumn("band", F.struct("start", "band_no", "header"))
    return J.first_band(rows, whole, TABLE, "row", "start", "stop", "band")


def photos_of(ready: DataFrame) -> DataFrame:
    """A row per picture: the cell's background first, then those inside; photo_no counts them in a table."""
    both = F.concat(
        F.when(F.col("image_id").isNotNull(), F.array(F.struct(F.col("image_id").cast("int").alias("id"), F.lit("background").alias("how")))).otherwise(F.array().cast("array<struct<id:int,how:string>>")),
        F.transform(F.coalesce("inline_ids", F.array().cast("array<int>")), lambda i: F.struct(i.cast("int").alias("id"), F.when(i == F.col("image_id"), "background").otherwise("inline").alias("how"))),
    )
    rows = ready.filter("is_photo").select(*TABLE, "cell_no", "row", "col", "row_end", "col_end", "col_span", "flat", "named", "band", F.posexplode(both).alias("nth", "p"))
    rows = rows.select("*", F.col("p.id").alias("bin_id"), F.col("p.how").alias("placement")).drop("p")
    return R.running_number(rows, TABLE, ["cell_no", "nth"], "photo_no")


def candidates(ready: DataFrame, placed: DataFrame) -> DataFrame:
    """Of cells and pictures, both with their band: TABLE, photo_no, band_no (of the picture), direction, cell_no, cell_row, cell_col, caption, exact, score."""
    ids = [*TABLE, "photo_no"]
    band_no = F.coalesce("band.band_no", F.lit(-1)).alias("band_no")
    row = lambda direction, cell, caption, exact, score: [F.lit(direction).alias("direction"), *cell, caption.alias("caption"), F.lit(exact).alias("exact"), score.cast("double").alias("score")]
    here = [F.col("cell_no"), F.col("row").alias("cell_row"), F.col("col").alias("cell_col")]
    own = placed.filter("named").select(*ids, band_no, *row("own", here, F.col("flat"), True, OWN + shape_bonus(F.col("flat"))))

    sides = F.explode(F.array(F.struct(F.lit("below").alias("d"), F.col("row_end").alias("r")), F.struct(F.lit("above").alias("d"), (F.col("row") - 1).alias("r"))))
    looking = placed.select(*ids, band_no, F.col("col").alias("pc"), F.col("col_end").alias("pe"), F.col("col_span").alias("ps"), sides.alias("s"))
    looking = looking.select("*", F.col("s.d").alias("direction"), F.col("s.r").alias("row")).drop("s")
    photo_rows = ready.filter("is_photo").select(*TABLE, "row").distinct().withColumn("with_photo", F.lit(True))
    cells = ready.filter("not is_photo and named").select(*TABLE, "cell_no", "row", "col", "col_end", "col_span", "flat", "band")
    cells = cells.join(photo_rows, [*TABLE, "row"], "left").withColumn("cell_band", F.coalesce("band.band_no", F.lit(-1)))
    met = looking.join(cells, [*TABLE, "row"]).withColumn("shared", F.least("pe", "col_end") - F.greatest("pc", "col")).filter("shared > 0")
    exact = (F.col("pc") == F.col("col")) & (F.col("ps") == F.col("col_span"))
    score = (
        F.when(exact, F.lit(float(EXACT))).otherwise(OVERLAP * F.col("shared") / F.greatest(F.lit(1), F.col("pe") - F.col("pc")))
        + F.when(F.col("direction") == "below", BELOW).otherwise(ABOVE)
        + shape_bonus(F.col("flat"))
        + F.when(F.col("cell_band") == F.col("band_no"), SAME_BAND).otherwise(OTHER_BAND)
        + F.when(F.col("with_photo").isNull(), NO_PHOTO_ROW).otherwise(0)
    )
    near = met.select(*ids, "band_no", "direction", *here, F.col("flat").alias("caption"), exact.alias("exact"), score.cast("double").alias("score"))

    heads = ready.filter("col = 0 and not is_photo").groupBy(*TABLE, F.col("row").alias("start")).agg(F.min("cell_no").alias("cell_no"))
    under = placed.filter("band.header <> ''").withColumn("start", F.col("band.start")).drop("cell_no").join(heads, [*TABLE, "start"])
    at = [F.col("cell_no"), F.col("start").alias("cell_row"), F.lit(0).alias("cell_col")]
    header = under.select(*ids, band_no, *row("header", at, F.col("band.header"), False, HEADER + shape_bonus(F.col("band.header"))))
    return own.unionByName(near).unionByName(header)


def voted(found: DataFrame) -> DataFrame:
    """Adds the votes' bonus: in each band the side that most undoubted pictures name."""
    sure = found.filter("exact and direction in ('below', 'above')")
    winners = R.direction_votes(sure, [*TABLE, "photo_no"], [*TABLE, "band_no"], "direction", ("below", "above"))
    better = F.when(F.col("winner") == F.col("direction"), VOTE).otherwise(0)
    return found.join(winners, [*TABLE, "band_no"], "left").withColumn("score", F.col("score") + better).drop("winner")


def resolve_captions(cells: DataFrame) -> DataFrame:
    """A row per picture: TABLE, cell_no, photo_no, row, col, bin_id, placement, caption, band, caption_source."""
    ready = written(_ready(cells), "cells")
    ready = written(with_band(ready, bands(ready)), "cells-banded")
    photos = photos_of(ready)
    found = voted(candidates(ready, photos))
    kind = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("direction"))
    pairs = found.filter(F.col("score") >= ACCEPTED).withColumns({"kind": kind, "shared": F.col("direction") == "header"})
    order = [F.desc("score"), F.col("photo_no"), F.col("kind"), F.col("cell_no")]
    named = best_pairs(pairs, [*TABLE, "photo_no"], [*TABLE, "cell_row", "cell_col"], order, "shared").select(*TABLE, "photo_no", "caption", "direction")
    rows = photos.join(named, [*TABLE, "photo_no"], "left")
    names = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])
    return rows.select(
        *TABLE, "cell_no", "photo_no", "row", "col", "bin_id", "placement", F.coalesce("caption", F.lit("")).alias("caption"),
        F.when(F.col("direction") == "header", "").otherwise(F.coalesce("band.header", F.lit(""))).alias("band"),
        F.coalesce(names[F.col("direction")], F.lit("")).alias("caption_source"),
    )


def slots(captions: DataFrame, floating: DataFrame | None = None) -> DataFrame:
    """Pictures of a document in order (doc_order): those of tables, then floating ones."""
    rows = captions.select("doc", "section", "table_order", "cell_no", "photo_no", "row", "col", "bin_id", "placement", "caption", "band", "caption_source")
    if floating is not None:
        rows = rows.unionByName(floating.select("doc", "section", F.lit(1 << 30).alias("table_order"), F.col("para").cast("int").alias("cell_no"), F.col("nth").cast("int").alias("photo_no"),
                                                F.lit(-1).alias("row"), F.lit(-1).alias("col"), "bin_id", F.lit("floating").alias("placement"), "caption", F.lit("").alias("band"), "caption_source"))
    inline = F.col("placement") == "floating"
    ordered = rows.withColumn("_f", inline)
    return R.running_number(ordered, ["doc"], ["_f", "section", "table_order", "cell_no", "photo_no"], "doc_order").drop("_f")


def floating_captions(pictures: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Pictures outside tables, named by the next paragraph, else by the one before, if short enough.

    pictures: doc, section, para, nth, bin_id. paragraphs: doc, section, para, text.
    """
    text = paragraphs.select("doc", "section", "para", T.normalize(F.col("text")).alias("t"))
    where = ["doc", "section"]
    near = J.as_of(pictures, text.withColumnRenamed("t", "after"), where, "para", ["after"], ties=["after"], after=True, strict=True)
    near = J.as_of(near, text.withColumnRenamed("t", "before"), where, "para", ["before"], ties=["before"])
    after, before = F.col("after"), F.col("before")
    fits = lambda t: (t != "") & (F.length(t) <= T.MAX_CAPTION)
    caption = F.when(fits(after), after).when(fits(before), before).otherwise("")
    source = F.when(fits(after), "다음 문단").when(fits(before), "앞 문단").otherwise("")
    return near.select("doc", "section", "para", "nth", "bin_id", caption.alias("caption"), source.alias("caption_source"))


def extract_fields(cells: DataFrame) -> DataFrame:
    """doc, key, value: the first cell to the right of a heading that is more than a mark; stops at an empty one.

    The first pair of a key wins in reading order; keys count without their spaces too.
    """
    ready = _ready(cells)
    place = [*TABLE, "row"]
    starts = ready.groupBy(*place, "col").agg(F.min_by(F.struct("flat", "col_end"), "cell_no").alias("n"))
    plain = ~F.trim(F.coalesce("text", F.lit(""))).contains("\n")
    walk = ready.filter((F.col("flat") != "") & (F.length("flat") <= T.MAX_CAPTION) & plain).select(
        *place, "cell_no", F.col("flat").alias("key"), F.col("col_end").alias("col"), F.lit("").alias("value"), F.lit(False).alias("over")
    )
    for _ in range(HOPS):
        step = walk.join(starts, [*place, "col"], "left")
        text = F.col("n.flat")
        stop = F.col("n").isNull() | (text == "")
        mark = text.rlike(T.SYMBOLS_ONLY)
        value = F.when(F.col("over") | stop | mark | (F.length(text) > T.MAX_FIELD_VALUE), F.col("value")).otherwise(text)
        over = F.col("over") | stop | ~F.coalesce(mark, F.lit(False))
        walk = step.select(*place, "cell_no", "key", F.coalesce("n.col_end", "col").alias("col"), value.alias("value"), over.alias("over"))
    pairs = walk.filter("value <> ''").withColumn("key", F.explode(F.array_distinct(F.array("key", F.replace("key", F.lit(" "), F.lit("")))))).select("doc", "section", "table_order", "cell_no", "key", "value")
    return R.first_value(pairs, ["doc", "key"], "value", ["section", "table_order", "cell_no"])
