"""The whole job: documents, photos, matches, places and outputs."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import imaging as I
from tesserae.functions import similarity as S
from tesserae.functions import text as T
from tesserae.operators import matching as M
from tesserae.operators import ranking as R
from tesserae.plans import index, outputs, placement
from tesserae.sources import files, images
from tesserae.sources.documents import Documents, read_documents

FOLDER = "_findings"


@dataclass
class Config:
    documents: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    dest: str = ""
    cache: str | None = None
    name_template: str = "{이름}"
    lowres: str = placement.PLAIN
    flat: bool = False
    strict: bool = False
    allow_duplicate: bool = False
    overwrite: bool = False
    dry_run: bool = False
    create_missing: bool = True
    include_floating: bool = False
    recursive: bool = True
    fast_index: bool = True
    allow_same_size: bool = False
    make_report: bool = True
    report_path: str | None = None
    thumbs: str = "auto"

    @property
    def index_path(self) -> str:
        return self.cache or f"{self.dest.rstrip('/')}/{FOLDER}/index"


@dataclass
class Result:
    ok: bool = False
    error: str = ""
    documents: int = 0
    photos: int = 0
    candidates: int = 0
    counts: dict[str, int] = field(default_factory=lambda: {S.CERTAIN: 0, S.REVIEW: 0, S.NOT_FOUND: 0})
    lowres_used: int = 0
    skipped: list[str] = field(default_factory=list)
    csv_path: str | None = None
    state_path: str | None = None
    report_path: str | None = None
    elapsed: float = 0.0
    cancelled: bool = False


class Cancelled(Exception):
    """The caller asked to stop."""


def build_queries(spark: SparkSession, items: DataFrame, work: str) -> tuple[DataFrame, DataFrame]:
    """queries and variants of embedded pictures; items: doc, bin_id, data, hint."""
    query_id = F.sha1(F.concat_ws("\n", "doc", F.col("bin_id").cast("string")))
    rows = items.filter(F.length("data") > 0).withColumn("query_id", query_id)
    heads = images.headers(rows.select(F.col("query_id").alias("path"), F.col("data").alias("content")))
    hints = rows.select("query_id", F.col("hint.original_name").alias("hint_name"), F.col("hint.width").alias("hint_width"), F.col("hint.height").alias("hint_height"))
    queries = heads.select(F.col("path").alias("query_id"), "taken_at", "subsec", "model", "unique_id", (F.col("width") * F.col("height")).alias("pixels"), "head_sha1").join(hints, "query_id")
    folder = f"{work}/pictures"
    paths = [r.path for r in images.staged_files(rows.select(F.col("query_id").alias("name"), "data"), folder).select("path").collect()] if rows.limit(1).count() else []
    shape = f"query_id string, ordinal int, orientation string, width int, height int, {I.PRINT_SCHEMA}"
    if not paths:
        return queries, spark.createDataFrame([], shape)
    turned = images.variant_fingerprints(images.decoded(spark, [folder]))
    return queries, turned.withColumn("query_id", F.regexp_extract("path", r"([0-9a-f]{40})$", 1)).drop("path").select(*[c.split(" ")[0] for c in shape.split(", ")])


def match(spark: SparkSession, items: DataFrame, records: DataFrame, work: str, allow_same_size: bool = False) -> DataFrame:
    """doc, bin_id, verdict, best, runners_up, message of every embedded picture."""
    queries, variants = build_queries(spark, items, work)
    keep = lambda df, name: (df.write.parquet(f"{work}/{name}"), spark.read.parquet(f"{work}/{name}"))[1]
    queries, variants = keep(queries, "queries"), keep(variants, "variants")
    found = keep(M.candidates(queries, variants, records), "candidates")
    close = keep(M.ties(found), "ties")
    if close.limit(1).count():
        own = images.fine_pixels(images.decoded(spark, [f"{work}/pictures"])).select(F.regexp_extract("path", r"([0-9a-f]{40})$", 1).alias("query_id"), F.col("fine").alias("a"))
        for n, batch in enumerate(images.batches_of(close.select("path").distinct())):
            theirs = images.fine_pixels(images.decoded(spark, batch)).select("path", F.col("fine").alias("b"))
            found = keep(M.refine(found, close.join(own, "query_id").join(theirs, "path")), f"refined-{n}")
    decided = M.decide(found, queries, allow_same_size)
    ids = items.select("doc", "bin_id", F.sha1(F.concat_ws("\n", "doc", F.col("bin_id").cast("string"))).alias("query_id"))
    return ids.join(decided, "query_id").drop("query_id")


def run(spark: SparkSession, config: Config, say: Callable[[str], None] = lambda text: None, should_stop: Callable[[], bool] = lambda: False) -> Result:
    result, began = Result(), time.time()
    work = f"{(config.dest or '/tmp').rstrip('/')}/{FOLDER}/work-{uuid.uuid4().hex}"

    def check() -> None:
        if should_stop():
            raise Cancelled

    try:
        _run(spark, config, result, "file://" + os.path.abspath(work) if "://" not in work else work, say, check)
    except Cancelled:
        result.cancelled, result.error = True, "멈췄습니다. 색인은 그대로 있으니 다음에 이어집니다."
    except ValueError as e:
        result.error = str(e)
    finally:
        system, at = index._file_system(spark, work)
        system.delete(at, True)
    if result.error:
        say(result.error)
    result.elapsed = time.time() - began
    return result


def _run(spark: SparkSession, config: Config, result: Result, work: str, say: Callable[[str], None], check: Callable[[], None]) -> None:
    if not config.documents:
        raise ValueError("읽을 한글 파일이 없습니다.")
    if not config.sources:
        raise ValueError("사진 폴더를 지정하지 않았습니다.")
    if not config.dest:
        raise ValueError("결과 폴더를 지정하지 않았습니다.")
    for source in config.sources:
        system, at = index._file_system(spark, source)
        if not system.exists(at):
            raise ValueError(f"사진 폴더가 없습니다: {source}")
    found = files.scan_documents(spark, config.documents, config.recursive, with_content=True)
    keep = lambda df, name: (df.write.parquet(f"{work}/{name}"), spark.read.parquet(f"{work}/{name}"))[1]
    parsed = keep(read_documents(found.withColumn("path", images.same_path(F.col("path"))), config.include_floating), "parsed")
    if not parsed.limit(1).count():
        raise ValueError("읽을 한글 파일이 없습니다.")
    documents = Documents(parsed.filter("error is null"))
    result.skipped = [os.path.basename(r.doc) for r in parsed.filter("error is not null").select("doc").collect()]
    result.documents = documents.docs.count()
    slots = keep(documents.slots(), "slots")
    result.photos = slots.count()
    say(f"문서의 사진 칸: {result.photos}")
    if not result.photos:
        raise ValueError("문서에 사진 칸이 없습니다.")
    check()
    stats = index.refresh(spark, config.sources, config.index_path, config.fast_index)
    result.candidates = stats["total"]
    if not result.candidates:
        raise ValueError("사진 폴더에 읽을 사진이 없습니다.")
    say(f"색인한 사진: {stats['total']:,} (새로 {stats['new_read']:,}, 그대로 {stats['reused']:,})")
    check()
    fields = keep(documents.fields(), "fields")
    matched = keep(match(spark, documents.items, index.load(spark, config.index_path, config.sources), work, config.allow_same_size), "matched")
    rows = slots.join(matched, ["doc", "bin_id"], "left")
    none = F.lit("문서에 이 사진의 자료가 없음")
    rows = rows.withColumns({"verdict": F.coalesce("verdict", F.lit(S.NOT_FOUND)), "message": F.coalesce("message", none), "runners_up": F.coalesce("runners_up", F.array().cast(f"array<{M.PICK}>"))})
    if not config.allow_duplicate:
        rows = M.assign_exclusive(rows)
    named = placement.plan_names(rows, fields, config.name_template)
    folders = _folders(spark, config, documents.docs, fields)
    result.skipped += [os.path.basename(r.doc) for r in folders.filter("folder is null").select("doc").collect()]
    planned = placement.plan(named, documents.items, folders, lowres=config.lowres, strict=config.strict)
    existing = _existing(spark, config.dest)
    if not config.overwrite:
        planned = placement.free_targets(planned, existing)
    planned = keep(planned, "plan")
    if not config.dry_run:
        if config.overwrite:
            placement.remove(placement.stale_files(planned, existing))
        planned = keep(placement.carry_out(planned, documents.items), "placed")
    counts = R.histogram(planned, "verdict", [S.CERTAIN, S.REVIEW, S.NOT_FOUND], {"low": (F.col("origin") == placement.LOWRES) & (F.col("skipped") == "")}).collect()
    result.counts = {r.verdict: r.n for r in counts}
    result.lowres_used = sum(r.low for r in counts)
    if not config.dry_run:
        out = f"{config.dest.rstrip('/')}/{FOLDER}"
        result.csv_path = outputs.write_csv(outputs.csv_rows(planned), f"{out}/결과목록.csv")
        result.state_path = outputs.write_state(planned, f"{out}/상태.json")
        if config.make_report:
            result.report_path = outputs.write_report(planned, documents.items, config.report_path or f"{out}/검토리포트.html", config.thumbs)
    result.ok = True


def _folders(spark: SparkSession, config: Config, docs: DataFrame, fields: DataFrame) -> DataFrame:
    if config.flat:
        return docs.select("doc", F.lit(config.dest.rstrip("/")).alias("folder"), F.lit("모두 같은 폴더").alias("how"), F.lit(False).alias("created"))
    system, at = index._file_system(spark, config.dest)
    names = [s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()] if system.exists(at) else []
    existing = spark.createDataFrame([(n,) for n in names if n != FOLDER], "folder string")
    return placement.resolve_folders(docs.select("doc"), fields, existing, config.dest, config.create_missing)


def _existing(spark: SparkSession, dest: str) -> DataFrame:
    system, at = index._file_system(spark, dest)
    if not system.exists(at) or not any(True for _ in system.listStatus(at)):
        return spark.createDataFrame([], "target string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(dest)
    return found.select(images.same_path(F.col("path")).alias("target")).filter(~F.col("target").contains(f"/{FOLDER}/"))


def scan(spark: SparkSession, paths: list[str], recursive: bool = True, include_floating: bool = False) -> DataFrame:
    """Slots of documents, without looking for originals."""
    found = files.scan_documents(spark, paths, recursive, with_content=True)
    return Documents(read_documents(found, include_floating).filter("error is null")).slots()


def apply_corrections(spark: SparkSession, csv_path: str, state_path: str, dry_run: bool = False) -> DataFrame:
    """What a reviewer chose, carried out: a row per correction with its target or why it failed.

    A source replaces the placed file; an empty one puts the document's own picture back.
    """
    state = files.read_state(spark, state_path)
    fixes = files.read_corrections(spark, csv_path)
    last = state.groupBy("doc_name", "name").agg(F.max_by(F.struct("doc_no", "photo_no", "doc", "folder", "bin_id", "target"), F.struct("doc_no", "photo_no")).alias("s"))
    joined = fixes.join(last, ["doc_name", "name"], "left").select("line", "doc_name", "name", "source", "s.*")
    wanted = [r.doc for r in joined.filter("source = '' and doc is not null").select("doc").distinct().toLocalIterator()]
    if wanted:
        items = Documents(read_documents(spark.read.format("binaryFile").load(wanted).withColumn("path", images.same_path(F.col("path"))))).items
    else:
        items = spark.createDataFrame([], "doc string, bin_id int, ext string, data binary")
    rows = joined.join(items.select("doc", "bin_id", "ext", "data"), ["doc", "bin_id"], "left")
    bare = F.regexp_replace("target", r"\.[^./]*$", "")
    suffix = F.when(F.col("source") != "", F.coalesce(F.nullif(T.suffix(F.col("source")), F.lit("")), T.suffix(F.col("target")))).otherwise(T.lowres_suffix(F.col("ext")))
    planned = rows.withColumn("new_target", F.concat(bare, suffix))
    why = F.when(F.col("doc").isNull(), "앞서 넣은 기록이 없음").when((F.col("source") == "") & (F.coalesce(F.length("data"), F.lit(0)) == 0), "문서에 이 사진의 자료가 없음").otherwise("")
    planned = planned.withColumn("skipped", why)
    return planned if dry_run else outputs.correct(spark, planned.orderBy("line"), state, state_path)
