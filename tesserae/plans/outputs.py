"""Lists, state and the review page. Rows come to the driver one by one, never all at once."""

from __future__ import annotations

import base64
import csv
import html
import json
import os
import shutil
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import similarity as S
from tesserae.functions import text as T

# Columns of the result list.
HEADER = ("한글파일", "사진이름", "구역", "이름출처", "판정", "점수", "크기배수", "넣은파일", "가져온곳", "종류", "메모")
NOT_PLACED, CHOSEN = "넣지않음", "사람이 고름"
ALL_THUMBS = 200


def csv_rows(placed: DataFrame) -> DataFrame:
    """The result list as columns, in the order of documents and pictures."""
    number = lambda c, f: F.when(F.coalesce(c, F.lit(0.0)) > 0, F.format_string(f, c)).otherwise("")
    note = F.coalesce(F.nullif("skipped", F.lit("")), F.nullif("message", F.lit("")), F.col("best.reason"), F.lit(""))
    values = [
        T.base_name(F.col("doc")), F.col("name"), F.col("band"), F.col("caption_source"), F.when(F.col("skipped") != "", NOT_PLACED).otherwise(F.col("verdict")),
        number(F.col("best.score"), "%.3f"), number(F.col("best.size_ratio"), "%.1f배"), F.coalesce("target", F.lit("")), F.col("source"), F.col("origin"), note,
    ]
    return placed.orderBy("doc", "doc_order").select(*[v.alias(h) for v, h in zip(values, HEADER, strict=True)])


def _open(path: str, **options):
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    return open(path, "w", encoding=options.pop("encoding", "utf-8"), **options)


def write_csv(rows: DataFrame, path: str) -> str:
    """One file with a byte order mark, which spreadsheets ask for."""
    with _open(path, encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for r in rows.toLocalIterator():
            out.writerow(r)
    return path


def write_state(placed: DataFrame, path: str) -> str:
    """Where each picture of each document went, for later corrections."""
    photo = F.struct(F.col("name").alias("이름"), F.col("bin_id").alias("번호"), F.coalesce("target", F.lit("")).alias("넣은파일"), F.col("origin").alias("종류"), F.col("verdict").alias("판정"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("doc_order", photo.alias("p")))), lambda x: x["p"])
    docs = placed.groupBy("doc").agg(F.first("folder").alias("folder"), ordered.alias("photos")).orderBy("doc")
    entry = F.struct(T.base_name(F.col("doc")).alias("문서"), F.col("doc").alias("문서경로"), F.col("folder").alias("폴더"), F.col("photos").alias("사진"))
    with _open(path) as f:
        f.write('{"version": 1, "documents": [')
        for k, r in enumerate(docs.select(F.to_json(entry).alias("j")).toLocalIterator()):
            f.write((",\n " if k else "\n ") + r.j)
        f.write("\n]}\n")
    return path


def _as_thumb(data: bytes | None) -> str:
    kinds = {b"\xff\xd8": "jpeg", b"\x89P": "png", b"GI": "gif", b"BM": "bmp"}
    kind = kinds.get(bytes(data[:2])) if data else None
    return f"data:image/{kind};base64,{base64.b64encode(data).decode()}" if kind else ""


def distinguish(paths: list[str]) -> list[str]:
    """File names, with their folder where a name occurs twice."""
    names = [os.path.basename(p) for p in paths]
    return [n if names.count(n) == 1 else f"{n} ({os.path.basename(os.path.dirname(p))})" for n, p in zip(names, paths, strict=True)]


_STYLE = "body{font-family:sans-serif;margin:2em}img{max-width:300px;max-height:300px}.slot{border:1px solid #ccc;margin:1em 0;padding:1em}.hidden{display:none}"
_SCRIPT = """
function show(v){document.querySelectorAll('.slot').forEach(function(s){s.classList.toggle('hidden', v !== '' && s.dataset.verdict !== v)})}
function cell(t){return '"' + String(t).replace(/"/g, '""') + '"'}
function save(){
  var lines = ['한글파일,사진이름,가져올파일'];
  document.querySelectorAll('.slot').forEach(function(s){
    var c = s.querySelector('input:checked');
    if (c && c.dataset.first !== '1') lines.push([s.dataset.doc, s.dataset.name, c.value].map(cell).join(','));
  });
  var a = document.createElement('a');
  a.href = URL.createObjectURL(new Blob(['\\ufeff' + lines.join('\\r\\n')], {type: 'text/csv'}));
  a.download = '수정목록.csv'; a.click();
}"""


def write_report(placed: DataFrame, items: DataFrame, path: str, thumbs: str = "auto") -> str:
    """A page by itself: totals, filters, pictures side by side, and a list of changed choices to save.

    thumbs: all, attention (only what isn't certain), none, or auto: all up to ALL_THUMBS pictures.
    """
    totals = {r.verdict: r.n for r in placed.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    n = sum(totals.values())
    shown = ("all" if n <= ALL_THUMBS else "attention") if thumbs == "auto" else thumbs
    wanted = F.lit(shown == "all") | (F.lit(shown == "attention") & (F.col("verdict") != S.CERTAIN))
    rows = placed.join(items.select("doc", "bin_id", "data"), ["doc", "bin_id"], "left").withColumn("data", F.when(wanted, F.col("data"))).orderBy("doc", "doc_order")
    esc = lambda v: html.escape(str(v or ""), quote=True)
    with _open(path) as f:
        f.write(f"<!DOCTYPE html><html lang='ko'><head><meta charset='utf-8'><title>검토 리포트</title><style>{_STYLE}</style><script>{_SCRIPT}</script></head><body>")
        f.write(f"<h1>검토 리포트</h1><p>사진 {n}장</p><button onclick=\"show('')\">모두</button>")
        for v in (S.CERTAIN, S.REVIEW, S.NOT_FOUND):
            f.write(f"<button onclick=\"show('{v}')\">{v} {totals.get(v, 0)}</button>")
        f.write("<button onclick='save()'>수정목록 저장</button>")
        for doc, group in groupby(rows.toLocalIterator(), key=lambda r: r.doc):
            f.write(f"<h2>{esc(os.path.basename(doc))}</h2>")
            for r in group:
                f.write(f"<div class='slot' data-verdict='{esc(r.verdict)}' data-doc='{esc(os.path.basename(doc))}' data-name='{esc(r['name'])}'><h3>{esc(r['name'])} — {esc(r.verdict)}</h3>")
                if r.data:
                    f.write(f"<img src='{_as_thumb(bytes(r.data))}' alt='한글 속 사진'>")
                picks = ([r.best] if r.best else []) + list(r.runners_up or [])
                names = distinguish([p.path for p in picks])
                for k, (p, name) in enumerate(zip(picks, names, strict=True)):
                    first = int(bool(r.best) and k == 0)
                    image = f"<img src='file://{esc(p.path)}' alt=''>" if shown != "none" else ""
                    f.write(f"<label><input type='radio' name='c{esc(r.doc)}-{r.doc_order}' value='{esc(p.path)}' data-first='{first}'{' checked' if first else ''}>{image}{esc(name)} — {esc(p.reason)}</label><br>")
                f.write(f"<label><input type='radio' name='c{esc(r.doc)}-{r.doc_order}' value='' data-first='{int(not r.best)}'{'' if r.best else ' checked'}>맞는 원본이 없음</label><p>{esc(r.message)} {esc(r.skipped)}</p></div>")
        f.write("</body></html>")
    return path


def correct(spark: SparkSession, planned: DataFrame, state: DataFrame, state_path: str) -> DataFrame:
    """Carries corrections out one after another, as later ones may undo earlier ones, and writes the state anew."""
    done, changed = [], {}
    for r in planned.toLocalIterator():
        note = r.skipped
        if not note:
            try:
                old, new = r.target, r.new_target
                os.makedirs(os.path.dirname(new) or ".", exist_ok=True)
                if r.source:
                    source = "/" + r.source.removeprefix("file:").lstrip("/")
                    if not os.path.exists(source):
                        raise OSError(f"가져올 파일이 없음: {source}")
                    shutil.copy2(source, new + ".part")
                else:
                    with open(new + ".part", "wb") as f:
                        f.write(bytes(r.data))
                os.replace(new + ".part", new)
                if old and old != new and os.path.exists(old):
                    os.remove(old)
                changed[r.doc_no, r.photo_no] = new, "원본" if r.source else "저용량"
            except OSError as e:
                note = str(e)
        done.append((r.line, r.doc_name, r.name, r.new_target if not note else None, note))
    if changed:
        with open(state_path.removeprefix("file://"), encoding="utf-8") as f:
            tree = json.load(f)
        for (doc_no, photo_no), (target, origin) in changed.items():
            tree["documents"][doc_no]["사진"][photo_no] |= {"넣은파일": target, "종류": origin, "판정": CHOSEN}
        with _open(state_path + ".part") as f:
            json.dump(tree, f, ensure_ascii=False, indent=1)
        os.replace(state_path.removeprefix("file://") + ".part", state_path.removeprefix("file://"))
    return spark.createDataFrame(pd.DataFrame(done, columns=["line", "doc_name", "name", "target", "skipped"]), "line long, doc_name string, name string, target string, skipped string")
