"""Scans of photo and document folders, by Spark's binaryFile source; contents are read only if asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T

# Suffixes of photos and documents, folders that hold no photos, first bytes of files.
RAW_SUFFIXES = (".nef", ".cr2", ".cr3", ".arw", ".dng", ".orf", ".rw2", ".pef", ".srw", ".raf", ".3fr")
PHOTO_SUFFIXES = (".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".tif", ".tiff", ".bmp", ".gif", ".webp", ".heic", ".heif", *RAW_SUFFIXES)
DOCUMENT_SUFFIXES = (".hwp", ".hwpx")
SKIPPED_FOLDERS = (".git", "__pycache__", "$RECYCLE.BIN", "System Volume Information", ".Trash", ".Trashes", "node_modules")
IMAGE_STARTS = (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF8", b"BM", b"II*\x00", b"MM\x00*", b"RIFF", b"\x01\x00\x00\x00", b"\xd7\xcd\xc6\x9a")
OLE_START, ZIP_START = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK\x03\x04"
HEAD_BYTES = 65_536


def _files(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    return reader.load(roots)


def _below(path: Column, roots: list[str]) -> Column:
    """The path's part after its root, so that folders above a root are no concern."""
    bare = F.regexp_replace(path, "^file:/*", "/")
    cut = bare
    for root in roots:
        start = root.removeprefix("file:").rstrip("/")
        start = "/" + start.lstrip("/") if "://" not in root else root.rstrip("/")
        cut = F.when(bare.startswith(start + "/"), F.substring(bare, len(start) + 2, 1 << 20)).otherwise(cut)
    return cut


def scan_photos(spark: SparkSession, roots: list[str], with_content: bool = False) -> DataFrame:
    """path, size, mtime[, content] of the photos below roots, without hidden and system folders."""
    files = _files(spark, roots)
    parts = F.split(_below(F.col("path"), roots), "/")
    names = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(parts, lambda p: p.startswith(".")) | F.arrays_overlap(names, F.array(*[F.lit(n) for n in SKIPPED_FOLDERS]))
    photos = files.filter(F.lower(T.suffix(F.col("path"))).isin(*PHOTO_SUFFIXES) & ~hidden)
    columns = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime")]
    return photos.select(*columns, *(["content"] if with_content else []))


def scan_documents(spark: SparkSession, roots: list[str], recursive: bool = True, with_content: bool = False) -> DataFrame:
    """Distinct document files below roots in the order of their paths, without lock files."""
    files = _files(spark, roots, recursive)
    kept = files.filter(F.lower(T.suffix(F.col("path"))).isin(*DOCUMENT_SUFFIXES) & ~T.base_name(F.col("path")).startswith("~"))
    columns = ["path", F.col("length").alias("size"), *(["content"] if with_content else [])]
    return kept.select(*columns).dropDuplicates(["path"]).orderBy("path")


def format_of(content: Column, path: Column) -> Column:
    """hwp or hwpx by the first bytes, else by suffix."""
    return (
        F.when(F.substring(content, 1, 8) == F.lit(OLE_START), "hwp")
        .when(F.substring(content, 1, 4) == F.lit(ZIP_START), "hwpx")
        .when(F.lower(T.suffix(path)) == ".hwpx", "hwpx")
        .otherwise("hwp")
    )


def is_image(content: Column) -> Column:
    found = F.lit(False)
    for start in IMAGE_STARTS:
        found = found | (F.substring(content, 1, len(start)) == F.lit(start))
    return found


def head_sha1(content: Column, size: Column | None = None, cut: bool = True) -> Column:
    """SHA-1 of the size in decimal, then of the first 64 KiB. cut=False: content is the head already, however long its encoding is."""
    n = (F.length(content) if size is None else size).cast("string")
    return F.sha1(F.concat(n.cast("binary"), F.substring(content, 1, HEAD_BYTES) if cut else content))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A row per placed picture of a state file; a file without documents gives none."""
    photo = "struct<`이름`: string, `번호`: int, `넣은파일`: string, `종류`: string, `판정`: string>"
    schema = f"version int, documents array<struct<`문서`: string, `문서경로`: string, `폴더`: string, `사진`: array<{photo}>>>"
    docs = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("documents").alias("doc_no", "d"))
    rows = docs.select("doc_no", "d.*").select("*", F.posexplode("사진").alias("photo_no", "p"))
    return rows.select("doc_no", "photo_no", F.col("문서").alias("doc_name"), F.col("문서경로").alias("doc"), F.col("폴더").alias("folder"), F.col("p.이름").alias("name"),
                       F.col("p.번호").alias("bin_id"), F.col("p.넣은파일").alias("target"), F.col("p.종류").alias("origin"), F.col("p.판정").alias("verdict"))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """line, doc_name, name, source of a list of corrections; a byte order mark is no part of a name."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    rows = rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])
    cell = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return rows.select(F.monotonically_increasing_id().alias("line"), cell("한글파일").alias("doc_name"), cell("사진이름").alias("name"), cell("가져올파일").alias("source"))
