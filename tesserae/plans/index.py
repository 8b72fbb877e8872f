"""The photo index: Parquet in buckets of paths. A refresh reads files that are new or changed and rewrites the buckets of what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import imaging as I
from tesserae.functions import similarity as S
from tesserae.operators import joins as J
from tesserae.operators import ranking as R
from tesserae.operators.merge import file_system, merge, read_buckets
from tesserae.sources import files, images

#: Part of the snapshot's path: an index of another version is built anew.
VERSION = 6
COLUMNS = (
    "path string, size bigint, mtime double, width int, height int, taken_at string, subsec string, make string, model string, settings string, gps string, "
    f"unique_id string, head_sha1 string, thumbed boolean, {I.PRINT_SCHEMA}, error string"
)


def _snapshot(index_path: str) -> str:
    return f"{index_path.rstrip('/')}/v{VERSION}"


_file_system = file_system


def load(spark: SparkSession, index_path: str, roots: list[str] | None = None) -> DataFrame:
    """The index, or an empty one; with roots, only what is below them."""
    rows = read_buckets(spark, _snapshot(index_path), COLUMNS)
    return rows if roots is None else rows.filter(below("path", roots))


def below(column: str, roots: list[str]):
    path = images.same_path(F.col(column))
    hit = F.lit(False)
    for r in roots:
        plain = "/" + r.removeprefix("file:").lstrip("/") if "://" not in r or r.startswith("file:") else r
        hit = hit | (path == plain.rstrip("/")) | path.startswith(plain.rstrip("/") + "/")
    return hit


def analyse(spark: SparkSession, paths: list[str], work_dir: str, fast: bool = True) -> DataFrame:
    """Index rows of files. With fast, a camera's thumbnail of the right shape stands for the picture."""
    found = spark.read.format("binaryFile").load(paths)
    rows = found.select(images.same_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), "content")
    heads = f"{work_dir}/heads-{uuid.uuid4().hex}"
    images.headers(rows).join(rows.select("path", "size", "mtime"), "path").write.parquet(heads)
    meta = spark.read.parquet(heads)
    turns = meta.select("path", "orientation")
    prints = None
    rest = [r.path for r in meta.select("path").collect()]  # one batch of paths
    if fast:
        thumbs = meta.filter("thumb is not null and exif_width > 0 and exif_height > 0")
        small = images.staged_files(thumbs.select(F.sha1("path").alias("name"), F.col("thumb").alias("data")), f"{work_dir}/thumbs-{uuid.uuid4().hex}")
        small = [r.path for r in small.collect()]
        if small:
            shown = images.decoded(spark, small).withColumn("name", F.regexp_extract("path", r"([0-9a-f]{40})$", 1)).drop("path")
            named = thumbs.select(F.sha1("path").alias("name"), "path", "exif_width", "exif_height")
            gap = S.aspect_gap(F.col("width") / F.col("height"), F.col("exif_width") / F.col("exif_height"))
            shown = shown.join(named, "name").filter(gap <= I.THUMB_TOLERANCE)
            prints = images.fingerprints(shown.select("path", "height", "width", "channels", "data"), turns).withColumn("thumbed", F.lit(True))
            done = {r.path for r in shown.select("path").collect()}
            rest = [p for p in rest if p not in done]
    if rest:
        whole = images.fingerprints(images.decoded(spark, rest), turns).withColumn("thumbed", F.lit(False))
        prints = whole if prints is None else prints.unionByName(whole)
    joined = meta.drop("thumb").join(prints, "path", "left")
    error = F.when(F.col("gray").isNull(), "그림을 해석하지 못함").otherwise("")
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    return joined.withColumns({"error": error, "thumbed": F.coalesce("thumbed", F.lit(False))}).select(*names)


def refresh(spark: SparkSession, roots: list[str], index_path: str, fast: bool = True) -> dict[str, int]:
    """Brings the index up to date with the photos below roots; rows of other roots stay. Gives counts."""
    known = load(spark, index_path)
    current = files.scan_photos(spark, roots).withColumn("path", images.same_path(F.col("path")))
    same = (F.col("k.size") == F.col("c.size")) & (F.abs(F.col("k.mtime") - F.col("c.mtime")) < 1e-6)
    work = f"{index_path.rstrip('/')}/work-{uuid.uuid4().hex}"
    J.snapshot_diff(known.filter(below("path", roots)).select("path", "size", "mtime"), current, "path", same).write.parquet(f"{work}/diff")
    diff = spark.read.parquet(f"{work}/diff")
    parts = f"{work}/read"
    spark.createDataFrame([], COLUMNS).write.parquet(parts)
    for batch in images.batches_of(diff.filter("state in ('new', 'changed')")):
        analyse(spark, batch, work, fast).write.mode("append").parquet(parts)
    now = spark.read.schema(COLUMNS).parquet(parts)
    states = diff.join(now.select("path", "error", "thumbed"), "path", "left")
    read = F.col("state").isin("new", "changed")
    counts = R.refresh_stats(states, read & (F.col("error") != ""), read & F.col("thumbed")).first().asDict()
    merge(spark, _snapshot(index_path), COLUMNS, "path", now, diff.filter("state <> 'same'").select("path"), work)
    system, at = file_system(spark, work)
    system.delete(at, True)
    return {k: int(v) for k, v in counts.items()}
