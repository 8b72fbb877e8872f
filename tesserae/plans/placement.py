"""What goes where under which name: plans are DataFrames, effects come last."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import similarity as S
from tesserae.functions import text as T
from tesserae.operators import names as N
from tesserae.operators import ranking as R
from tesserae.operators.stages import written

PLAIN, SUFFIX, SUBDIR, SKIP = "plain", "suffix", "subdir", "skip"
ORIGINAL, LOWRES = "원본", "저용량"
# Fields of a document that may name its folder, strongest first.
FOLDER_FIELDS = ("도면 명칭", "도면명칭", "유적명", "유적 명칭", "연번")


def use_original(path: Column, verdict: Column, strict: bool) -> Column:
    sure = (verdict == S.CERTAIN) | ((verdict == S.REVIEW) & F.lit(not strict))
    return path.isNotNull() & sure


def number_captions(slots: DataFrame) -> DataFrame:
    """Adds numbered: the sanitised caption, with (1), (2), ... where a document has it more than once."""
    safe = slots.withColumn("_safe", T.sanitize(F.coalesce("caption", F.lit("")), "사진"))
    return R.number_duplicates(safe, ["doc"], "_safe", ["doc_order"], "numbered").drop("_safe")


def plan_names(slots: DataFrame, fields: DataFrame, template: str = "{이름}") -> DataFrame:
    """Adds name, without suffix. slots: doc, doc_order, caption, band. fields: doc, key, value."""
    numbered = number_captions(slots)
    if template.strip() in ("", "{이름}"):
        return numbered.withColumnRenamed("numbered", "name")
    maps = fields.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_fields"))
    own = F.create_map(
        F.lit("이름"), F.col("numbered"), F.lit("구역"), F.coalesce("band", F.lit("")), F.lit("파일명"), T.stem(T.base_name(F.col("doc"))),
        F.lit("번호"), F.lpad(F.col("doc_order").cast("string"), 2, "0"),
    )
    known = F.coalesce("_fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    title = F.create_map(F.lit("도면명칭"), F.coalesce(F.try_element_at(known, F.lit("도면 명칭")), F.lit("")))
    rest = F.map_filter(known, lambda k, v: ~k.isin("이름", "구역", "파일명", "번호"))
    with_title = F.when(F.map_contains_key(rest, "도면명칭"), rest).otherwise(F.map_concat(F.map_filter(rest, lambda k, v: k != "도면명칭"), title))
    filled = T.apply_template(template, F.map_concat(with_title, own))
    return numbered.join(maps, "doc", "left").withColumn("name", F.coalesce(F.nullif(filled, F.lit("")), "numbered")).drop("_fields", "numbered")


def _folder_answers(asked: DataFrame, named: DataFrame) -> DataFrame:
    """doc, step, how, answer, made, order: every folder that a document's name or fields mean, in steps of falling strength.

    asked: doc, value, tier. named: folder, made. Equal names first (of the file, then of its fields), then names inside the file's name, the
    longest first, then close ones; numbers must agree throughout. Folders that are there go before those that are made.
    """
    loose = lambda c: T.loose(T.nfc(c))
    digits = lambda c: T.digit_signature(T.nfc(c))
    named = named.select("folder", "made", loose(F.col("folder")).alias("norm"), digits(F.col("folder")).alias("fd"))
    asked = asked.withColumns({"norm": loose(F.col("value")), "dd": digits(F.col("value"))})
    agree = T.digits_agree(F.col("fd"), F.col("dd"))
    turn = F.when(F.col("made"), "1").otherwise("0")
    names = F.array(*[F.lit(f"'{n}' 값과 폴더 이름이 같음" if n else "문서와 폴더 이름이 같음") for n in ("", *FOLDER_FIELDS)])
    row = lambda step, how, order: ["doc", step.alias("step"), how.alias("how"), F.col("folder").alias("answer"), "made", order.alias("order")]
    equal = asked.join(named, "norm").filter(agree).select(*row(F.col("tier"), F.get(names, F.col("tier")), F.concat(turn, "folder")))
    own, after = asked.filter("tier = 0"), len(FOLDER_FIELDS) + 1
    held = N.inside(own, named, "norm", "norm").join(own.withColumnRenamed("norm", "text"), "text").join(named.withColumnRenamed("norm", "name"), "name").filter(agree)
    long_first = F.concat(F.lpad((10_000 - F.length("folder")).cast("string"), 6, "0"), turn, "folder")
    held = held.select(*row(F.lit(after), F.lit("문서 이름이 폴더 이름을 품음"), long_first))
    near = N.close_candidates(asked, named, "value", "folder").join(asked.withColumnRenamed("value", "text"), "text").join(named.withColumnRenamed("folder", "name"), "name").filter(agree)
    near = near.select("doc", "tier", "text", "name", "made").withColumn("ratio", T.name_ratio("name", "text")).filter(F.col("ratio") >= N.CLOSE).withColumnRenamed("name", "folder")
    falling = F.lpad((1_000_000_000 - F.round(F.col("ratio") * 1_000_000_000)).cast("long").cast("string"), 10, "0")
    near = near.select(*row(F.lit(after + 1) + F.col("tier"), F.lit("폴더 이름이 가까움"), falling))
    return equal.unionByName(held).unionByName(near)


def _makers(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, made of the documents that find no folder when they come in order: one that an earlier document had to make is found by later ones.

    docs: doc, own (the folder it would make). A document is settled once an earlier maker's folder answers it, or no earlier document that
    may still make one of its answers is open: those settle in rounds, and each round settles the first open document at least.
    """
    there = answers.filter("not made").select("doc").distinct()
    open_ = docs.join(there, "doc", "left_anti").select("doc", "own")
    may = answers.filter("made").select("doc", F.col("answer").alias("own")).distinct().withColumnRenamed("doc", "by")
    makers = None
    while True:
        open_ = written(open_, "open")
        if open_.isEmpty():
            return makers if makers is not None else open_.select("doc", F.col("own").alias("made"))
        first = open_.groupBy("own").agg(F.min("doc").alias("first"))
        asks = open_.select(F.col("doc").alias("by")).join(may, "by").join(first, "own").filter(F.col("first") < F.col("by")).select(F.col("by").alias("doc")).distinct()
        now = written(open_.join(asks, "doc", "left_anti").select("doc", F.col("own").alias("made")), "makers")
        makers = now if makers is None else makers.unionByName(now)
        by = now.groupBy("made").agg(F.min("doc").alias("maker"))
        found = may.join(by, F.col("own") == F.col("made")).filter(F.col("maker") < F.col("by")).select(F.col("by").alias("doc")).distinct()
        open_ = open_.join(now, "doc", "left_anti").join(found, "doc", "left_anti")


def resolve_folders(docs: DataFrame, fields: DataFrame, folders: DataFrame, dest: str, create_missing: bool = True) -> DataFrame:
    """doc, folder, how, created, ambiguous. docs: doc, doc_name; folders: folder (a name below dest).

    Documents come in the order of their paths: a folder that one has to make answers later ones by any step, and none before it.
    """
    stem = T.stem(T.base_name(F.col("doc")))
    wanted = docs.select("doc", stem.alias("value"), F.lit(0).alias("tier"))
    for k, name in enumerate(FOLDER_FIELDS):
        wanted = wanted.unionByName(fields.filter(F.col("key") == name).select("doc", "value", F.lit(k + 1).alias("tier")))
    own = docs.select("doc", T.sanitize(stem).alias("own"))
    named = folders.select("folder", F.lit(False).alias("made"))
    if create_missing:
        own = written(own, "folders-own")
        new = own.select(F.col("own").alias("folder")).distinct().join(folders.select("folder"), "folder", "left_anti")
        named = named.unionByName(new.withColumn("made", F.lit(True)))
    answers = _folder_answers(wanted.filter("value is not null"), named)
    if create_missing:
        answers = written(answers, "folders")
        makers = _makers(answers, own)
        by = makers.groupBy(F.col("made").alias("answer")).agg(F.min("doc").alias("maker"))
        answers = answers.join(by, "answer", "left").filter(~F.col("made") | (F.col("maker") < F.col("doc")))
    best = Window.partitionBy("doc").orderBy("step", "order", F.desc("answer"))
    ranked = answers.withColumns({"_n": F.row_number().over(best), "_step": F.min("step").over(Window.partitionBy("doc"))}).filter("step = _step")
    found = ranked.groupBy("doc").agg(
        F.min_by("answer", "_n").alias("answer"), F.min_by("how", "_n").alias("how"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_n").between(2, 3), F.struct("_n", "answer")))), lambda x: x["answer"]).alias("ambiguous"),
    )
    rows = own.join(found, "doc", "left")
    folder = F.coalesce("answer", "own") if create_missing else F.col("answer")
    none = "알맞은 폴더가 없어 만듦" if create_missing else "알맞은 폴더 없음"
    return rows.select(
        "doc", F.when(folder.isNotNull(), F.concat(F.lit(dest.rstrip("/") + "/"), folder)).alias("folder"), F.coalesce("how", F.lit(none)).alias("how"),
        (F.col("answer").isNull() & F.lit(create_missing)).alias("created"), F.coalesce("ambiguous", F.array().cast("array<string>")).alias("ambiguous"),
    )


def plan(matches: DataFrame, items: DataFrame, folders: DataFrame, *, lowres: str = PLAIN, strict: bool = False) -> DataFrame:
    """A row per slot with origin, source, target and skipped. matches: doc, doc_order, name, bin_id, verdict, best, message ..."""
    stored = items.select("doc", "bin_id", "ext", "stream", (F.coalesce(F.length("data"), F.lit(0)) > 0).alias("stored"))
    rows = matches.join(stored, ["doc", "bin_id"], "left").join(folders.select("doc", "folder"), "doc").filter("folder is not null")
    original = use_original(F.col("best.path"), F.col("verdict"), strict)
    missing = ~F.coalesce("stored", F.lit(False))
    skipped = F.when(original, "").when(missing, "문서에도 사진이 들어 있지 않음").when(F.lit(lowres == SKIP), "원본 없음").otherwise("")
    suffix = F.when(original, T.original_suffix(F.col("best.path"))).otherwise(T.lowres_suffix(F.col("ext")))
    marked = F.concat("name", F.lit(f"({LOWRES})")) if lowres == SUFFIX else F.col("name")
    stem = T.sanitize(F.when(original, F.col("name")).otherwise(marked))
    below = F.lit(f"/_{LOWRES}" if lowres == SUBDIR else "")
    directory = F.concat("folder", F.when(original, "").otherwise(below))
    source = F.when(original, F.col("best.path")).otherwise(F.concat(T.base_name(F.col("doc")), F.lit("에서 꺼냄: "), F.coalesce("stream", F.lit(""))))
    return rows.select(
        "*", original.alias("original"), F.when(original, ORIGINAL).otherwise(LOWRES).alias("origin"), skipped.alias("skipped"),
        F.when(skipped == "", source).otherwise("").alias("source"), directory.alias("directory"), stem.alias("stem"), suffix.alias("suffix"),
    ).withColumn("target", F.when(F.col("skipped") == "", F.concat_ws("/", "directory", F.concat("stem", "suffix"))))


def _numbered(path: Column) -> tuple[Column, Column]:
    """A path without its -N before the suffix, and N: null where it has no such end, or one that no name gets."""
    cut = F.regexp_extract(path, r"^(.*)-([1-9]\d{0,8})(\.[^./]*)?$", 2)
    bare = F.regexp_replace(path, r"-[1-9]\d{0,8}(\.[^./]*)?$", "$1")
    return bare, F.when(cut != "", F.try_to_number(cut, F.lit("999999999")).cast("int"))


def free_targets(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """target changed to name-2, name-3, ... where it exists or an earlier slot has it. existing: target.

    Slots that want one path get its free numbers in the order of (doc, doc_order). Paths of different names
    can meet (the second ``a`` and ``a-2``): the earlier slot keeps such a path, and the other one goes into
    the next pass with all later slots of its name. Passes end when nobody has to move.
    """
    order = F.struct("doc", "doc_order")
    bare, number = _numbered(F.col("target"))
    taken = existing.select("target").distinct()
    waiting = planned.filter("target is not null").select("doc", "doc_order", F.col("target").alias("wanted"), "directory", "stem", "suffix")
    done = None
    while True:
        used = taken.select(bare.alias("wanted"), number.alias("n")).filter("n >= 2").groupBy("wanted").agg(F.array_sort(F.collect_set("n")).alias("_used"))
        rows = R.running_number(waiting, ["wanted"], ["doc", "doc_order"], "_k")
        rows = rows.join(taken.select(F.col("target").alias("wanted"), F.lit(1).alias("_plain")), "wanted", "left").join(used, "wanted", "left")
        nth = F.col("_k") - F.when(F.col("_plain").isNull(), 1).otherwise(0)
        free = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), nth + 1, lambda x, u: F.when(u <= x, x + 1).otherwise(x))
        path = F.when(nth == 0, F.col("wanted")).otherwise(F.concat("directory", F.lit("/"), "stem", F.lit("-"), free.cast("string"), "suffix"))
        rows = rows.select(*waiting.columns, "_k", path.alias("target"))
        clashes = rows.groupBy("target").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        moved = rows.join(clashes, "target").filter(order != F.col("_first")).groupBy("wanted").agg(F.min("_k").alias("_from"))
        rows = rows.join(moved, "wanted", "left").persist()
        settled = rows.filter("_from is null or _k < _from").select("doc", "doc_order", "target")
        done = settled if done is None else done.union(settled)
        later = rows.filter("_k >= _from").select(*waiting.columns)
        if not later.limit(1).count():
            break
        taken, waiting = taken.union(settled.select("target")), later
    placed = planned.filter("target is not null").drop("target").join(done, ["doc", "doc_order"]).select(*planned.columns)
    return placed.unionByName(planned.filter("target is null"))


def stale_files(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Files of an earlier run that an overwriting one takes away: same folder and stem, other suffix; never a source."""
    key = lambda df, path: df.withColumns({"_dir": F.regexp_replace(F.col(path), r"/[^/]*$", ""), "_stem": T.stem(T.name_key(F.col(path)))})
    placed = planned.filter("target is not null")
    same = key(existing.select("target"), "target").join(key(placed.select("target"), "target").select("_dir", "_stem").distinct(), ["_dir", "_stem"], "left_semi")
    kept = placed.select("target").union(placed.filter("original").select(F.col("source").alias("target")))
    return same.select("target").join(kept.distinct(), "target", "left_anti")


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def remove(files: DataFrame) -> int:
    """Takes files (target) away, in the tasks that list them; one that is gone already is no error."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = [_local(x) for x in pdf["target"]]
            there = [x for x in paths if os.path.exists(x)]
            for x in there:
                os.remove(x)
            yield pd.DataFrame({"n": [len(there)]})

    return files.select("target").mapInPandas(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def carry_out(planned: DataFrame, items: DataFrame) -> DataFrame:
    """Copies originals and writes embedded pictures; gives the plan with failures in skipped.

    Every file is written under a name of its own and renamed, so a task that runs twice does no harm.
    """
    data = items.select("doc", "bin_id", "data")
    rows = planned.join(data, ["doc", "bin_id"], "left").withColumn("data", F.when(~F.col("original"), F.col("data")))
    schema = rows.drop("data").schema

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            notes, targets = [], []
            for r in pdf.itertuples(index=False):
                note, target = r.skipped, r.target
                if not note and target:
                    try:
                        path = _local(target)
                        os.makedirs(os.path.dirname(path), exist_ok=True)
                        part = f"{path}.part-{os.getpid()}"
                        if r.original:
                            shutil.copy2(_local(r.source), part)
                        else:
                            with open(part, "wb") as f:
                                f.write(r.data)
                        os.replace(part, path)
                    except OSError as e:
                        note, target = f"파일을 쓰지 못함: {e}", None
                notes.append(note)
                targets.append(target)
            yield pdf.drop(columns=["data"]).assign(skipped=notes, target=targets)

    return rows.mapInPandas(work, schema)
