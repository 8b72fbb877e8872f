"""Pictures as fingerprints: decoded by Spark's image source, measured per partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import imaging as I
from tesserae.sources.files import head_sha1

#: Paths that one read takes: what the driver holds of a listing.
PATH_BATCH = 20_000


def same_path(path: Column) -> Column:
    """file:/x, file:///x and /x as one."""
    return F.regexp_replace(path, r"^file:/+", "/")


def headers(files: DataFrame) -> DataFrame:
    """path, content -> path, header sizes, EXIF values, head_sha1 and the camera's thumbnail."""
    schema = f"path string, width int, height int, {I.EXIF_SCHEMA}, thumb binary"

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                exif, size = I.exif_of(data), I.size_of(data)
                size = size or ((exif["exif_width"], exif["exif_height"]) if exif["exif_width"] and exif["exif_height"] else (0, 0))
                turned = exif["orientation"] in (5, 6, 7, 8)
                out.append({"path": path, "width": size[turned], "height": size[not turned], **exif, "thumb": I.thumbnail(data)})
            yield pd.DataFrame(out)

    hashed = files.select("path", head_sha1(F.col("content")).alias("head_sha1"))
    return files.select("path", "content").mapInPandas(work, schema).join(hashed, "path")


def staged_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes name, data below folder; gives name, path. Names must be unique."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            system, base = fs.FileSystem.from_uri(folder)
            system.create_dir(base, recursive=True)
            for name, data in zip(pdf["name"], pdf["data"], strict=True):
                part = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(part, compression=None) as out:
                    out.write(bytes(data))
                system.move(part, f"{base}/{name}")
            yield pd.DataFrame({"name": pdf["name"], "path": [f"{folder.rstrip('/')}/{n}" for n in pdf["name"]]})

    return rows.select("name", "data").mapInPandas(work, "name string, path string")


def decoded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, height, width, channels, data of the pictures that ImageIO can read."""
    rows = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
    return rows.select(same_path(F.col("origin")).alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def fingerprints(images: DataFrame, orientations: DataFrame | None = None) -> DataFrame:
    """path and PRINT_SCHEMA of pictures, seen as their orientation says. orientations: path, orientation."""
    rows = images.withColumn("orientation", F.lit(1)) if orientations is None else images.join(orientations, "path", "left")

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rgb = I.from_spark_image(r.height, r.width, r.channels, bytes(r.data))
                turn = 1 if pd.isna(r.orientation) else int(r.orientation)
                yield pd.DataFrame([{"path": r.path, **I.fingerprint(I.upright(rgb, turn))}])

    return rows.select("path", "height", "width", "channels", "data", "orientation").mapInPandas(work, f"path string, {I.PRINT_SCHEMA}")


def variant_fingerprints(images: DataFrame) -> DataFrame:
    """path, ordinal, orientation, width, height and PRINT_SCHEMA of each way a picture may have been turned."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rgb = I.from_spark_image(r.height, r.width, r.channels, bytes(r.data))
                yield pd.DataFrame([{"path": r.path, **v} for v in I.variants(rgb)])

    return images.mapInPandas(work, f"path string, ordinal int, orientation string, width int, height int, {I.PRINT_SCHEMA}")


def _pixels(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "u1").astype("i2")


def fine_pixels(images: DataFrame) -> DataFrame:
    """path, fine: pixels for a close comparison."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame([{"path": r.path, "fine": _pixels(I.fine(I.from_spark_image(r.height, r.width, r.channels, bytes(r.data))))}])

    return images.mapInPandas(work, "path string, fine array<smallint>")


def batches_of(paths: DataFrame, size: int = PATH_BATCH) -> Iterator[list[str]]:
    """Paths in lists of bounded length, without holding all of them."""
    held: list[str] = []
    for row in paths.select("path").toLocalIterator():
        held.append(row.path)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
