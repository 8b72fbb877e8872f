"""Claims that are settled in many rounds, with few of them written."""

from pyspark.sql import functions as F

from tesserae.functions import similarity as S
from tesserae.operators import assignment
from tesserae.operators.matching import assign_exclusive

PICK = "struct<path: string, score: double, size_ratio: double, width: int, height: int, reason: string>"
SLOTS = f"doc string, doc_order int, best {PICK}, runners_up array<{PICK}>, verdict string, message string"


def chain(n):
    """Slot 0 takes what slot 1 wants, which takes what slot 2 wants, and so on: a round each."""
    pick = lambda k, score: (f"p{k}", score, 1.0, 1, 1, "")
    return [("a", 0, pick(0, 1.0), [], S.CERTAIN, "")] + [("a", k, pick(k - 1, 0.5), [pick(k, 0.9)], S.CERTAIN, "") for k in range(1, n + 1)]


def test_long_chain_with_few_writes(spark, monkeypatch):
    writes, write = [], assignment.written
    monkeypatch.setattr(assignment, "written", lambda df, label: writes.append(label) or write(df, label))
    alone = [("b", 1, None, None, S.NOT_FOUND, ""), ("b", 2, chain(1)[0][2], None, S.CERTAIN, "m"), ("c", 1, None, [chain(1)[0][2]], S.NOT_FOUND, "")]
    rows = {(r.doc, r.doc_order): r for r in assign_exclusive(spark.createDataFrame(chain(14) + alone, SLOTS)).collect()}
    assert [rows["a", k].best.path for k in range(15)] == [f"p{k}" for k in range(15)]
    assert [rows["a", k].verdict for k in (0, 1, 14)] == [S.CERTAIN, S.REVIEW, S.REVIEW]
    assert rows["b", 1].best is None and rows["b", 1].runners_up is None and rows["b", 2].best.path == "p0" and rows["b", 2].runners_up is None and len(rows["c", 1].runners_up) == 1
    assert len(writes) <= 3


def test_groups_stay_where_they_are_dealt(spark):
    claims = spark.createDataFrame([("a", 0, [("p", 1.0), ("q", 1.0)])], "doc string, n int, picks array<struct<path: string, score: double>>")
    settled = assignment.settle(claims, ["doc"], "n", "picks", "path", "score")
    assert settled.select("doc", "n", F.col("_at")).collect() == [("a", 0, 0)]


def test_key_hits_alone_are_grouped_by_version(spark, monkeypatch):
    from tesserae.operators import matching as M

    lines = spark.range(400).selectExpr("cast(id div 8 as string) as query_id", "concat('p', id) as path", "if(id % 4 = 0, 'k', '') as exif_key", "id % 3 = 0 as name_match", "id % 5 = 0 as exif_conflict", "id % 7 / 10.0 as score", "cast(id % 9 as int) as width", "1 as height", "id as size", "if(id % 8 < 4, 'u', '') as unique_id")
    none = {"taken_at": "string", "subsec": "string", "model": "string", "dhash": "array<bigint>", "gray": "array<double>", "tiles": "array<double>"}
    found = lines.withColumns({name: F.lit(None).cast(kind) for name, kind in none.items()})
    sizes, write = [], M.written
    monkeypatch.setattr(M, "written", lambda df, label: sizes.append((label, df.count())) or write(df, label))
    rows = M._ranked(found).collect()
    hits = [r for r in rows if r.exif_key and not r.exif_conflict]
    assert dict(sizes)["key-hits"] == len(hits) == 80 and len(rows) == 400
    for q in {r.query_id for r in rows}:
        own = [r for r in rows if r.query_id == q]
        clean = sorted((r for r in own if not r.exif_conflict), key=lambda r: (not r.exif_key, not r.name_match, -r.score, r.path))
        assert [r.nth for r in clean] == list(range(1, len(clean) + 1))
        kept = sorted((r for r in own if r.kept), key=lambda r: (-r.score, r.path))
        assert [r.hit for r in kept] == list(range(1, len(kept) + 1)) and all(r.hit is None for r in own if not r.kept)
    M.compiled(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
