"""Command line: scan, index, run, apply."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tesserae.plans import index, job, placement


def session() -> SparkSession:
    return SparkSession.builder.appName("tesserae").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def duration(seconds: float) -> str:
    """Seconds as hours, minutes and seconds."""
    n = int(seconds)
    parts = [(n // 3600, "시간"), (n // 60 % 60, "분"), (n % 60, "초")]
    return " ".join(f"{v}{u}" for v, u in parts if v) or "0초"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tesserae", description="Finds the originals of pictures in documents and puts them in order.")
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="show the pictures of documents and their names")
    scan.add_argument("documents", nargs="+")
    scan.add_argument("--no-recursive", dest="recursive", action="store_false")
    scan.add_argument("--include-floating", action="store_true")
    build = commands.add_parser("index", help="bring the photo index up to date")
    build.add_argument("sources", nargs="+")
    build.add_argument("--cache", required=True)
    build.add_argument("--full", dest="fast_index", action="store_false")
    run = commands.add_parser("run", help="match pictures and place originals")
    run.add_argument("--documents", nargs="+", required=True)
    run.add_argument("--sources", nargs="+", required=True)
    run.add_argument("--dest", required=True)
    run.add_argument("--cache")
    run.add_argument("--name-template", default="{이름}")
    run.add_argument("--lowres", choices=(placement.PLAIN, placement.SUFFIX, placement.SUBDIR, placement.SKIP), default=placement.PLAIN)
    for flag in ("flat", "strict", "allow-duplicate", "overwrite", "dry-run", "include-floating", "allow-same-size"):
        run.add_argument(f"--{flag}", action="store_true")
    for flag, dest in (("no-create", "create_missing"), ("no-recursive", "recursive"), ("full", "fast_index"), ("no-report", "make_report")):
        run.add_argument(f"--{flag}", dest=dest, action="store_false")
    run.add_argument("--report-path")
    run.add_argument("--thumbs", choices=("auto", "all", "attention", "none"), default="auto")
    fix = commands.add_parser("apply", help="carry out a reviewer's corrections")
    fix.add_argument("--csv", required=True)
    fix.add_argument("--state", required=True)
    fix.add_argument("--dry-run", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command, spark = args.pop("command"), spark or session()
    if command == "scan":
        for r in job.scan(spark, args["documents"], args["recursive"], args["include_floating"]).orderBy("doc", "doc_order").toLocalIterator():
            print(f"{r.doc}\t{r.doc_order}\t{r.caption}\t{r.band}\t{r.caption_source}")
        return 0
    if command == "index":
        for k, v in index.refresh(spark, args["sources"], args["cache"], args["fast_index"]).items():
            print(f"{k}\t{v}")
        return 0
    if command == "apply":
        rows = job.apply_corrections(spark, args["csv"], args["state"], args["dry_run"]).collect()
        failed = sum(bool(r.skipped) for r in rows)
        print(f"바꾼 사진 {len(rows) - failed}, 바꾸지 못한 사진 {failed}")
        return 0
    result = job.run(spark, job.Config(**args), say=lambda text: print(text, file=sys.stderr))
    print(f"확실 {result.counts['확실']} · 확인필요 {result.counts['확인필요']} · 못찾음 {result.counts['못찾음']} · {duration(result.elapsed)}")
    return 0 if result.ok else 1


if __name__ == "__main__":
    sys.exit(main())
