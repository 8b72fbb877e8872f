import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from tesserae import cli
from tesserae.functions import similarity as S
from tesserae.plans import index, job
from tesserae.streaming import ingest
from tests import builders as B


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    photos = root / "photos"
    (photos / ".hidden").mkdir(parents=True)
    for k in range(6):
        (photos / f"P{k}.png").write_bytes(B.png(B.noise(1200, 900, k), B.exif("Cam", f"2025:01:0{k + 1} 10:00:00", "11") if k < 2 else b""))
    (photos / ".hidden" / "x.png").write_bytes(B.png(B.noise(300, 300, 50)))
    (photos / "broken.jpg").write_bytes(b"\xff\xd8\xff broken")
    small = lambda k: B.png(B.shrunk(B.noise(1200, 900, k)))
    body = B.tbl(B.tc(0, 0, pic="a"), B.tc(0, 1, pic="b"), B.tc(1, 0, "전경"), B.tc(1, 1, "근경"), B.tc(2, 0, pic="c"), B.tc(3, 0, "유물"))
    with_exif = B.png(B.shrunk(B.noise(1200, 900, 0)), B.exif("Cam", "2025:01:01 10:00:00", "11"))
    items = [("a", "BinData/a.png", with_exif), ("b", "BinData/b.png", small(3)), ("c", "BinData/c.png", B.png(B.noise(400, 300, 77)))]
    docs = root / "docs"
    docs.mkdir()
    (docs / "서원_104 기록.hwpx").write_bytes(B.hwpx([body], items))
    (docs / "bad.hwp").write_bytes(b"nothing")
    (docs / "~lock.hwpx").write_bytes(b"")
    (root / "out" / "서원_104 기록").mkdir(parents=True)
    return root


def config(place, **more):
    return job.Config(documents=[str(place / "docs")], sources=[str(place / "photos")], dest=str(place / "out"), **more)


def test_index_reads_only_what_changed(spark, tmp_path):
    photos = tmp_path / "p"
    photos.mkdir()
    for k in range(3):
        (photos / f"{k}.png").write_bytes(B.png(B.noise(300, 200, k)))
    where = str(tmp_path / "index")
    counts = lambda: index.refresh(spark, [str(photos)], where)
    assert counts() == {"total": 3, "new_read": 3, "reused": 0, "gone": 0, "failed": 0, "thumbed": 0}
    (photos / "3.png").write_bytes(b"no picture")
    (photos / "0.png").unlink()
    (photos / "1.png").write_bytes(B.png(B.noise(310, 200, 9)))
    assert counts() == {"total": 3, "new_read": 2, "reused": 1, "gone": 1, "failed": 1, "thumbed": 0}
    rows = {os.path.basename(r.path): r for r in index.load(spark, where).collect()}
    assert sorted(rows) == ["1.png", "2.png", "3.png"] and rows["1.png"].width == 310 and rows["3.png"].error and len(rows["2.png"].dhash) == 4
    other = tmp_path / "q"
    other.mkdir()
    (other / "x.png").write_bytes(B.png(B.noise(300, 200, 4)))
    index.refresh(spark, [str(other)], where)
    assert index.load(spark, where).count() == 4 and index.load(spark, where, [str(other)]).count() == 1


def test_dry_run_places_nothing(spark, place):
    result = job.run(spark, config(place, dry_run=True, cache=str(place / "cache")))
    assert result.ok and result.photos == 3 and not list((place / "out" / "서원_104 기록").iterdir())


def test_job_and_corrections(spark, place):
    result = job.run(spark, config(place))
    assert result.ok, result.error
    assert (result.documents, result.photos, result.candidates, result.skipped) == (1, 3, 7, ["bad.hwp"])
    assert result.counts == {S.CERTAIN: 2, S.REVIEW: 0, S.NOT_FOUND: 1} and result.lowres_used == 1
    folder = place / "out" / "서원_104 기록"
    assert sorted(p.name for p in folder.iterdir()) == ["근경.png", "유물.png", "전경.png"]
    assert (folder / "전경.png").read_bytes() == (place / "photos" / "P0.png").read_bytes()
    assert (folder / "근경.png").read_bytes() == (place / "photos" / "P3.png").read_bytes()
    with open(result.csv_path, encoding="utf-8-sig", newline="") as f:
        rows = list(csv.DictReader(f))
    assert [r["판정"] for r in rows] == ["확실", "확실", "못찾음"] and rows[2]["종류"] == "저용량"
    page = open(result.report_path, encoding="utf-8").read()
    assert "전경" in page and "data:image/png;base64," in page and "수정목록" in page
    state = json.load(open(result.state_path, encoding="utf-8"))
    assert [p["이름"] for p in state["documents"][0]["사진"]] == ["전경", "근경", "유물"]
    fixes = place / "fixes.csv"
    doc = "서원_104 기록.hwpx"
    lines = [f"{doc},유물,{place}/photos/P5.png", f"{doc},전경,", f"{doc},없는것,", f"{doc},근경,/no/such.png"]
    fixes.write_text("﻿한글파일,사진이름,가져올파일\n" + "\n".join(lines) + "\n", encoding="utf-8")
    done = {r["name"]: r.skipped for r in job.apply_corrections(spark, str(fixes), result.state_path).collect()}
    assert not done["유물"] and not done["전경"] and done["없는것"] and done["근경"]
    assert (folder / "유물.png").read_bytes() == (place / "photos" / "P5.png").read_bytes()
    assert (folder / "전경.png").read_bytes() != (place / "photos" / "P0.png").read_bytes()
    state = json.load(open(result.state_path, encoding="utf-8"))
    assert {p["이름"]: p["판정"] for p in state["documents"][0]["사진"]}["유물"] == "사람이 고름"
    again = job.run(spark, config(place))
    assert again.ok and (folder / "전경-2.png").exists()
    assert job.run(spark, config(place, overwrite=True, lowres="subdir", make_report=False)).ok
    assert (folder / "_저용량" / "유물.png").exists()


@pytest.mark.parametrize("change, message", [({"documents": []}, "한글 파일이 없"), ({"sources": []}, "사진 폴더를 지정"), ({"dest": ""}, "결과 폴더"), ({"sources": ["/no/such"]}, "사진 폴더가 없습니다")])
def test_missing_parts_are_told(spark, place, change, message):
    c = config(place)
    for k, v in change.items():
        setattr(c, k, v)
    said = []
    result = job.run(spark, c, say=said.append)
    assert not result.ok and message in result.error and said


def test_jobs_can_be_stopped(spark, place):
    result = job.run(spark, config(place, cache=str(place / "cache2")), should_stop=lambda: True)
    assert result.cancelled and not result.ok


def test_command_line(spark, place, capsys):
    assert cli.main(["scan", str(place / "docs")], spark) == 0
    assert "전경" in capsys.readouterr().out
    assert cli.main(["index", str(place / "photos"), "--cache", str(place / "cache3")], spark) == 0
    assert "total\t7" in capsys.readouterr().out
    assert cli.duration(3725) == "1시간 2분 5초" and cli.duration(0) == "0초"
    with pytest.raises(SystemExit):
        cli.main(["run"], spark)


def test_new_photos_as_a_stream(spark, tmp_path):
    photos = tmp_path / "p"
    photos.mkdir()
    (photos / "a.png").write_bytes(B.png(B.noise(300, 200, 1)))
    go = lambda: ingest.ingest(spark, str(photos), str(tmp_path / "t"), str(tmp_path / "c"), "*.png").awaitTermination(120)
    go()
    (photos / "b.png").write_bytes(B.png(B.noise(300, 200, 2)))
    go()
    rows = spark.read.parquet(str(tmp_path / "t")).select(F.element_at(F.split("path", "/"), -1).alias("n"), "batch").collect()
    assert sorted(r.n for r in rows) == ["a.png", "b.png"] and len({r.batch for r in rows}) == 2
