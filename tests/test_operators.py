import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import similarity as S
from tesserae.functions import text as T
from tesserae.operators import captions as C
from tesserae.operators import hamming
from tesserae.operators import joins as J
from tesserae.operators import matching as M
from tesserae.operators import merge
from tesserae.operators import names as N
from tesserae.operators import ranking as R
from tesserae.operators.assignment import best_pairs
from tesserae.plans import placement, proxies


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


# --------------------------------------------------------------------------- text


@pytest.mark.parametrize("raw, want", [("  a \n b　c ", "a b c"), (None, ""), ("가", "가")])
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [("3. 전경", "전경"), ("55세 이상", "55세 이상"), ("사진 7. 벽면", "벽면"), ("① 유물", "유물"), ("(3) 것", "것")])
def test_clean_caption(spark, raw, want):
    assert one(spark, T.clean_caption(F.col("t"), True), t=raw) == want


@pytest.mark.parametrize("raw, want", [("전경", True), ("", False), ("-", False), ("12-3", False), ("가" * 41, False), ("1층", True)])
def test_caption_like(spark, raw, want):
    assert one(spark, T.is_caption_like(F.col("t")), t=raw) is want


@pytest.mark.parametrize(
    "raw, want",
    [("a/b:c?", "abc"), ("", "이름없음"), ("con", "_con"), ("com1.txt", "_com1.txt"), ("x.. ", "x"), ("a\n b", "a b"), ("가" * 60, "가" * 50), ("\ud800x", "x")],
)
def test_safe_names(raw, want):
    assert T.safe_name(raw) == want


def test_templates():
    assert T.fill_template("{도면명칭}_{이름}", {"이름": "전경"}) == "전경"
    assert T.fill_template("{a} - {b}", {"a": "x", "b": "y"}) == "x y" and T.fill_template("{a}__{b}", {"a": "x/", "b": "y"}) == "x_y"


@pytest.mark.parametrize("raw, want", [(' "C:\\a b\\" ', "C:\\a b"), ("'/x/'", "/x"), ("/", "/"), ("a", "a")])
def test_clean_path(spark, raw, want):
    assert one(spark, T.clean_path(F.col("t")), t=raw) == want


@pytest.mark.parametrize("a, b, want", [("나주_001", "나주_002", False), ("지석묘군3", "2031 지석묘군3", True), ("조사", "조사", True), ("조사", "조사1", False), ("1", "", False)])
def test_digits(spark, a, b, want):
    assert one(spark, T.digits_agree(T.digit_signature(F.col("a")), T.digit_signature(F.col("b"))), a=a, b=b) is want


def test_names(spark):
    assert one(spark, T.stem(F.col("t")), t="a.b.jpg") == "a.b" and one(spark, T.stem(F.col("t")), t=".x") == ".x"
    assert one(spark, T.useful_name(F.col("t")), t="CLP0a1b2c3d4e5f.bmp") is None and one(spark, T.useful_name(F.col("t")), t="DSC.JPG") == "DSC.JPG"
    assert one(spark, T.lowres_suffix(F.col("t")), t="JPEG") == ".jpg" and one(spark, T.original_suffix(F.col("t")), t="/a/B.JPG") == ".JPG"
    assert one(spark, T.human_size(F.col("t").cast("long")), t=2048) == "2.0KB" and one(spark, T.html_escape(F.col("t")), t="<&'\">") == "&lt;&amp;&#x27;&quot;&gt;"


# --------------------------------------------------------------------------- similarity and joins


def test_distances_as_numpy(spark):
    rnd = np.random.RandomState(1)
    a, b = rnd.rand(192) * 255, rnd.rand(192) * 255
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").select(
        S.ncc(F.col("a"), F.col("b")).alias("n"), S.tile_distance(F.col("a"), F.col("b")).alias("t"), S.chroma(F.col("a")).alias("c"), S.ncc(F.col("a"), F.transform("a", lambda x: F.lit(1.0))).alias("z")
    ).first()
    assert row.n == pytest.approx(np.corrcoef(a, b)[0, 1]) and row.t == pytest.approx(np.abs(a - b).mean()) and row.z == 0
    assert row.c == pytest.approx((a.reshape(-1, 3).max(1) - a.reshape(-1, 3).min(1)).mean())


def test_exif_keys_from_the_strongest(spark):
    keys = one(spark, S.exif_keys(F.col("u"), F.col("t"), F.col("s"), F.col("m")), u="id", t="T", s="5", m="M")
    assert [(k.name, k.key) for k in keys] == [(S.KEY_UID, "id"), (S.KEY_SUBSEC, "T|5|M"), (S.KEY_MODEL, "T|M"), (S.KEY_TIME, "T")]
    assert [k.name for k in one(spark, S.exif_keys(F.col("u"), F.col("t"), F.col("s"), F.col("m")), u="", t="T", s="5", m="")] == [S.KEY_TIME]


@pytest.mark.parametrize("a, b, s, t, want", [("x", "x", "", "", False), ("x", "y", "", "", True), ("", "y", "1", "2", False), ("x", "x", "1", "2", True), ("x", "x", "1", "", False), (None, "y", None, None, False)])
def test_capture_conflict(spark, a, b, s, t, want):
    assert one(spark, S.capture_conflict(*[F.col(c).cast("string") for c in "abst"]), a=a, b=b, s=s, t=t) is want


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hamming, "QUERY_BLOCK", block)
    monkeypatch.setattr(hamming, "ROW_BLOCK", 4 * block)
    rnd = np.random.RandomState(2)
    index = [(i, rnd.randint(-(2**62), 2**62, 4).tolist()) for i in range(60)]
    queries = [(q, v, rnd.randint(-(2**62), 2**62, 4).tolist()) for q in range(7) for v in range(3)]
    rows = J.top_k_hamming(spark.createDataFrame(queries, "q long, v int, w array<bigint>"), spark.createDataFrame(index, "i long, w array<bigint>").repartition(5), "q", "i", "w", 4, variant="v").collect()
    far = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True))
    want = set()
    for q in range(7):
        best = sorted((min((far(w, x), v) for k, v, w in queries if k == q)[0], i, min((far(w, x), v) for k, v, w in queries if k == q)[1]) for i, x in index)[:4]
        want |= {(q, i, d, v, r) for r, (d, i, v) in enumerate(best, 1)}
    assert {(r.q, r.i, r.distance, r.v, r.rank) for r in rows} == want
    assert J.top_k_hamming(spark.createDataFrame([], "q long, v int, w array<bigint>"), spark.createDataFrame(index, "i long, w array<bigint>"), "q", "i", "w", 4, variant="v").count() == 0


@pytest.mark.parametrize("word_bits", [64, 32])
def test_top_k_by_bands(spark, word_bits):
    """Codes around centres: rounds settle their queries; far ones are weighed against all rows."""
    rnd = np.random.RandomState(4)
    code = lambda: [int(x) for x in rnd.randint(0, 2**32, 2)] if word_bits == 32 else rnd.randint(-(2**62), 2**62, 1).tolist()
    centres = [code() for _ in range(40)]

    def near(c, flips):
        out = list(c)
        for b in rnd.randint(0, word_bits, flips):
            w = int(rnd.randint(len(out)))
            out[w] = int(np.array(out[w] & (2**64 - 1), "u8").view("i8") ^ np.array(1 << int(b), "u8").view("i8"))
        return out

    index = [(i, near(centres[i % 40], i // 40 % 7)) for i in range(1_200)] + [(i, code()) for i in range(1_200, 1_500)]
    queries = [(q, near(centres[q], 2)) for q in range(25)] + [(q, code()) for q in range(25, 28)] + [(28, None)]
    work = {}
    args = (spark.createDataFrame(queries, "q long, w array<bigint>"), spark.createDataFrame([*index, (9_999, None)], "i long, w array<bigint>").repartition(3))
    rows = J.top_k_hamming(*args, "q", "i", "w", 6, word_bits=word_bits, work=work).collect()
    far = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True))
    want = {(q, i, d, r) for q, w in queries if w for r, (d, i) in enumerate(sorted((far(w, x), i) for i, x in index)[:6], 1)}
    assert {(r.q, r.i, r.distance, r.rank) for r in rows} == want
    assert work["settled"] >= 25 and work["banded"] < 28 * 1_500 // 4 and work["whole"] <= 3 * 1_500


def test_bands_cover_what_they_claim():
    bands = hamming.Bands(4, 64, 10**9)
    assert bands.m == 8 and bands.width == 32 and bands.rounds(7) == 1 and bands.rounds(8) == 2
    small = hamming.Bands(2, 32, 2_000)
    assert small.m == 4 and small.pays(21) and not small.pays(22) and small.expected(2_000, 6) == 21


def test_first_tier_wins(spark):
    key = lambda *ks: [(t, f"n{t}", k) for t, k in ks]
    kind = "array<struct<tier: int, name: string, key: string>>"
    q = spark.createDataFrame([(1, key((0, "a"), (1, "b"))), (2, key((0, "z"), (1, "b")))], f"q long, keys {kind}")
    x = spark.createDataFrame([(10, key((0, "a"))), (11, key((1, "b"))), (12, key((0, "b")))], f"i long, keys {kind}")
    assert {(r.q, r.i, r.tier, r.name) for r in J.tiered_key_join(q, x, "q", "i").collect()} == {(1, 10, 0, "n0"), (2, 11, 1, "n1"), (2, 12, 1, "n1")}


def test_weaker_tiers_are_not_joined(spark, monkeypatch):
    """Only keys of the first tier reach the join of hits, and a hot key's hits come in parts."""
    monkeypatch.setattr(J, "HOT_ROWS", 10)
    kind = "array<struct<tier: int, name: string, key: string>>"
    q = spark.createDataFrame([(i, [(0, "id", f"a{i}"), (1, "day", "hot")]) for i in range(6)] + [(6, []), (7, None)], f"q long, keys {kind}")
    x = spark.createDataFrame([(100 + i, [(0, "id", f"a{i}"), (1, "day", "hot")]) for i in range(3)] + [(i, [(2, "day", "hot")]) for i in range(200)], f"i long, keys {kind}")
    chosen = {(r.q, r.key, r.tier, r.n) for r in J.first_tiers(q, x, "q", "i").collect()}
    assert chosen == {(i, f"a{i}", 0, 1) for i in range(3)} | {(i, "hot", 1, 203) for i in range(3, 6)}
    hits = {(r.q, r.i, r.tier, r.name) for r in J.tiered_key_join(q, x, "q", "i").collect()}
    assert hits == {(i, 100 + i, 0, "id") for i in range(3)} | {(i, y, 1, "day") for i in range(3, 6) for y in [*range(200), 100, 101, 102]}
    other = {(r.q, r.i) for r in J.tiered_key_join(q, x, "q", "i", other_than_self=True).collect()}
    assert other == {(i, y) for i, y, *_ in hits if i != y}


def test_hot_keys_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_ROWS", 7)
    rows = [(n, k) for n, k in enumerate(["hot", "hot", "cold", None, "none"])]
    index = [(n, "hot") for n in range(50)] + [(50, "cold"), (51, None), (50, "cold")]
    got = J.key_join(spark.createDataFrame(rows, "q int, k string"), spark.createDataFrame(index, "i int, k string"), "k").select("q", "i").collect()
    assert sorted(map(tuple, got)) == sorted((q, i) for q, k in rows for i, x in index if k is not None and k == x)


def test_interval_join_as_brute_force(spark):
    rnd = np.random.RandomState(3)
    inf = float("inf")
    rows = [(int(rnd.randint(3)), n, float(rnd.choice([rnd.randn() * 10.0 ** rnd.randint(-3, 6), rnd.randint(-5, 5), 1e18, -1e-9]))) for n in range(300)] + [(0, 300, None), (None, 301, 1.0)]
    bands = [(int(rnd.randint(3)), n, float(a := rnd.randn() * 10.0 ** rnd.randint(-3, 6)), float(a + abs(rnd.randn()) * 10.0 ** rnd.randint(-6, 7))) for n in range(120)]
    bands += [(0, 200, -inf, inf), (1, 201, 3.0, inf), (2, 202, 5.0, 5.0), (2, 203, 5.0, -5.0), (1, 204, None, 4.0), (0, 205, 1.0, 5.0), (1, 206, -2.0, 2.0)]
    got = J.interval_join(spark.createDataFrame(rows, "k int, n int, at double"), spark.createDataFrame(bands, "k int, b int, low double, high double"), ["k"], "at", "low", "high")
    want = sorted((n, b) for k, n, at in rows for j, b, low, high in bands if k == j and None not in (at, low) and low <= at < high)
    assert sorted((r.n, r.b) for r in got.collect()) == want and len(want) > 500
    assert J.interval_join(spark.createDataFrame(rows, "k int, n int, at double"), spark.createDataFrame([], "k int, b int, low double, high double"), ["k"], "at", "low", "high").count() == 0


@pytest.mark.parametrize("after, strict", [(False, False), (False, True), (True, False), (True, True)])
def test_as_of_as_brute_force(spark, after, strict):
    rnd = np.random.RandomState(9)
    rows = [(0 if n < 150 else int(rnd.randint(4)), n, int(rnd.randint(40))) for n in range(250)] + [(None, 250, 3), (0, 251, None)]
    facts = [(0 if n < 80 else int(rnd.randint(3)), int(rnd.randint(40)), f"f{n:03}") for n in range(120)] + [(None, 1, "x"), (0, None, "y")]
    got = J.as_of(spark.createDataFrame(rows, "k int, n int, at int").repartition(4), spark.createDataFrame(facts, "k int, at int, f string"), ["k"], "at", ["f"], ties=["f"], after=after, strict=strict).collect()
    fits = (lambda t, at: t > at or t == at and not strict) if after else (lambda t, at: t < at or t == at and not strict)
    assert len(got) == len(rows)
    for r in got:
        of = sorted((t, f) for k, t, f in facts if None not in (k, t, r.k, r.at) and k == r.k and fits(t, r.at))
        assert r.f == ((of[0] if after else of[-1])[1] if of else None)


def test_multimap_rows(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    assert sorted(tuple(r) for r in R.multimap(df, "k", "v").collect()) == [("a", 1, 2), ("a", 2, 2), ("b", 3, 1)]
    assert sorted(tuple(r) for r in R.multimap(df, "k", "v", 2).collect()) == [("a", 1, 2), ("a", 2, 2)]


def test_cascade_and_bands(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    step = lambda *rows: spark.createDataFrame(list(rows), "k string, answer string, order string")
    rows = {r.k: (r.answer, r.how, r.others) for r in J.cascade(wanted, "k", [("one", step(("a", "x", "2"), ("a", "w", "1"))), ("two", step(("a", "y", "0"), ("b", "z", "0")))]).collect()}
    assert rows == {"a": ("w", "one", ["x"]), "b": ("z", "two", []), "c": (None, None, None)}
    bands = spark.createDataFrame([(1, 0, 5, "low"), (1, 3, 9, "high")], "t int, s int, e int, b string")
    got = J.first_band(spark.createDataFrame([(1, 4), (1, 7), (1, 9), (2, 4)], "t int, at int"), bands, ["t"], "at", "s", "e", "b").collect()
    assert {(r.t, r.at, r.b) for r in got} == {(1, 4, "low"), (1, 7, "high"), (1, 9, None), (2, 4, None)}


def test_votes_need_one_side(spark):
    votes = [(1, 1, "below"), (1, 1, "above"), (1, 2, "above"), (2, 3, "below"), (2, 4, "above")]
    rows = R.direction_votes(spark.createDataFrame(votes, "band int, photo int, d string"), ["photo"], ["band"], "d", ("below", "above")).collect()
    assert [(r.band, r.winner) for r in rows] == [(1, "above")]


# --------------------------------------------------------------------------- captions

CELL = "doc string, section int, table_order int, cell_no int, row int, col int, row_span int, col_span int, text string, image_id int, inline_ids array<int>"


def table_rows(doc, *cells):
    """(row, col, text or picture number[, row_span, col_span])"""
    rows = []
    for n, (r, c, what, *spans) in enumerate(cells):
        rs, cs = spans or (1, 1)
        rows.append((doc, 0, 1, n, r, c, rs, cs, what if isinstance(what, str) else "", what if isinstance(what, int) else None, []))
    return rows


def table(spark, *cells):
    return spark.createDataFrame(table_rows("d", *cells), CELL)


BELOW, ABOVE, HEAD, OWN = (C.SOURCES[k] for k in ("below", "above", "header", "own"))
# Cells of a table, and the name, band and source that each of its pictures gets.
TABLES = {
    "below": ([(0, 0, 1), (0, 1, 2), (1, 0, "전경"), (1, 1, "근경")], {1: ("전경", "", BELOW), 2: ("근경", "", BELOW)}),
    # The last row has nothing below, so its picture votes for above.
    "above": ([(0, 1, "가"), (1, 1, 1), (2, 1, "나"), (3, 1, 2)], {1: ("가", "", ABOVE), 2: ("나", "", ABOVE)}),
    "width": ([(0, 1, 1, 1, 2), (1, 1, "넓은", 1, 2), (2, 1, 2, 1, 1), (3, 1, "걸친", 1, 3)], {1: ("넓은", "", BELOW), 2: ("걸친", "", BELOW)}),
    "shared header": ([(0, 0, "유구", 2, 1), (0, 1, 1), (1, 1, 2)], {1: ("유구", "", HEAD), 2: ("유구", "", HEAD)}),
    # Another band costs 35 points, which an exact cell below (101) can bear and a header (59) can't reach.
    "other band": ([(0, 0, "머리"), (0, 1, 1), (1, 0, "둘째"), (1, 1, "이름")], {1: ("이름", "머리", BELOW)}),
    "long header": ([(0, 0, "스무 글자보다 훨씬 더 긴 행 머리글입니다요"), (0, 1, 1)], {1: ("", "스무 글자보다 훨씬 더 긴 행 머리글입니다요", "")}),
    "no names": ([(0, 0, 1), (1, 0, "12-3")], {1: ("", "", "")}),
}


def test_captions(spark):
    rows = [r for name, (cells, _) in TABLES.items() for r in table_rows(name, *cells)]
    rows += [("own", 0, 1, 0, 0, 0, 1, 1, "자체", 1, [])] + table_rows("own", (1, 0, "아래"), (2, 0, "끝"))[0:0]
    rows += table_rows("once", (0, 1, 1), (1, 1, "하나"), (2, 1, 2))
    rows += [("inside", 0, 1, 0, 0, 0, 1, 1, "", 4, [4, 5]), ("inside", 0, 1, 1, 1, 0, 1, 1, "둘", None, [])]
    got = {}
    for r in C.resolve_captions(spark.createDataFrame(rows, CELL)).collect():
        got.setdefault(r.doc, []).append((r.bin_id, r.caption, r.band, r.caption_source, r.placement))
    for name, (_, want) in TABLES.items():
        assert {b: (c, d, e) for b, c, d, e, _ in got[name]} == want, name
    assert got["own"] == [(1, "자체", "", OWN, "background")]
    assert sorted(c for _, c, *_ in got["once"]) == ["", "하나"]  # a name serves one picture
    assert sorted((b, p) for b, *_, p in got["inside"]) == [(4, "background"), (4, "background"), (5, "inline")]


def plain_conversation(turns):
    """bin_id: (caption, source) of the second speaker's turns, from whole texts; turns: (turn, role, text)."""
    flat = {t: " ".join((x or "").split()) for t, _, x in turns}
    photo = {t for t, role, _ in turns if role == "assistant"}
    named = {t for t, x in flat.items() if 0 < len(x) <= 40 and not re.fullmatch(r"[\s0-9.,\-()]*", x)}
    shape = lambda x: 8 + 6 * (len(x) <= 20) - 14 * x.endswith(":") - 20 * (len(x) == 1)
    sides = {t: {d: t + k for d, k in (("below", 1), ("above", -1)) if t + k in named - photo} for t in photo}
    sure = [next(iter(x)) for x in sides.values() if len(x) == 1]
    bonus = {d: 15 * (2 * sure.count(d) > len(sure)) for d in ("below", "above")}
    found = [(-170 - shape(flat[t]), t, "own", t) for t in photo & named]
    for t, x in sides.items():
        found += [(-(100 + 25 + 10 + {"below": 12, "above": 8}[d] + bonus[d] + shape(flat[c])), t, d, c) for d, c in x.items()]
    out, taken = {t: ("", "") for t in photo}, set()
    for _, t, d, c in sorted(found, key=lambda f: (f[0], f[1], ["own", "below", "above"].index(f[2]))):
        if out[t] == ("", "") and c not in taken:
            out[t] = flat[c], C.SOURCES[d]
            taken.add(c)
    return out


def test_caption_query_reads_whole_texts(spark, tmp_path):
    rnd = np.random.RandomState(4)
    pool = ["a view", "x", "the north wall seen from outside, 1987", "a text that goes on, and on, well beyond the forty characters of a name", "12-3", "", "note:", "a  name\nin two lines"]
    rows = [(c, t, ("user", "assistant")[rnd.randint(2)], f"{pool[rnd.randint(8)]}") for c in range(60) for t in range(rnd.randint(1, 9))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.doc, r.bin_id): (r.caption, r.caption_source) for r in proxies.caption_resolution(spark, str(tmp_path)).collect()}
    want = {(f"conv{c}", t): v for c in range(60) for t, v in plain_conversation([r[1:] for r in rows if r[0] == c]).items()}
    assert got == want and any(len(v[0]) > 30 for v in want.values()) and ("", "") in want.values()


def test_fields(spark):
    cells = table(spark, (0, 0, "도면 명칭"), (0, 1, "나주_026"), (1, 0, "유적명"), (1, 1, ""), (1, 2, "다음"), (2, 0, "비고"), (2, 1, "-"), (2, 2, "값"), (3, 0, "도면 명칭"), (3, 1, "둘째"))
    got = {r.key: r.value for r in C.extract_fields(cells).collect()}
    assert got["도면 명칭"] == got["도면명칭"] == "나주_026" and "유적명" not in got and got["비고"] == "값"


def test_floating_captions(spark):
    pictures = spark.createDataFrame([("d", 0, 2, 0, 5), ("d", 0, 9, 1, 6)], "doc string, section int, para int, nth int, bin_id int")
    paragraphs = spark.createDataFrame([("d", 0, 1, "앞"), ("d", 0, 3, "다음")], "doc string, section int, para int, text string")
    got = {r.bin_id: (r.caption, r.caption_source) for r in C.floating_captions(pictures, paragraphs).collect()}
    assert got == {5: ("다음", "다음 문단"), 6: ("다음", "앞 문단")}


# --------------------------------------------------------------------------- verdicts


FOUND = (
    "query_id string, pixels long, path string, size long, width int, height int, taken_at string, subsec string, model string, unique_id string, head_sha1 string, "
    "dhash array<bigint>, phash bigint, gray array<double>, tiles array<double>, exif_key string, name_match boolean, orientation string, exif_conflict boolean, "
    "identical_file boolean, score double, has_visual boolean, refined boolean"
)


def candidate(path, score, **more):
    base = dict.fromkeys(M.RECORD) | {"path": path, "size": 10, "width": 4000, "height": 3000, "exif_key": "", "name_match": False, "orientation": S.AS_IS}
    return base | {"exif_conflict": False, "identical_file": False, "score": score, "has_visual": True, "refined": False, "pixels": 1000} | more


def found_of(spark, cases):
    names = [c.split()[0] for c in FOUND.split(", ")]
    rows = [tuple((c | {"query_id": q})[n] for n in names) for q, found in cases.items() for c in found]
    return spark.createDataFrame(rows, FOUND), spark.createDataFrame([(q,) for q in cases], "query_id string")


def decided(spark, cases, **more):
    return {r.query_id: r for r in M.decide(*found_of(spark, cases), **more).collect()}


CASES = [
    ([], S.NOT_FOUND, None),
    ([candidate("a", 0.95), candidate("b", 0.7)], S.CERTAIN, "a"),
    ([candidate("a", 0.95), candidate("b", 0.93)], S.REVIEW, "a"),
    ([candidate("a", 0.7)], S.REVIEW, "a"),
    ([candidate("a", 0.5)], S.NOT_FOUND, None),
    ([candidate("a", 0.99, exif_conflict=True)], S.NOT_FOUND, None),
    ([candidate("a", 0.99, exif_conflict=True), candidate("b", 0.9)], S.CERTAIN, "b"),
    ([candidate("a", 0.5, name_match=True), candidate("b", 0.8)], S.CERTAIN, "a"),
    ([candidate("a", 0.9, name_match=True, exif_conflict=True), candidate("b", 0.5)], S.NOT_FOUND, None),
    ([candidate("a", 0.5, exif_key=S.KEY_MODEL), candidate("b", 0.99)], S.CERTAIN, "a"),
    ([candidate("a", 0.5, exif_key=S.KEY_TIME)], S.REVIEW, "a"),
    ([candidate("a", 0.4, exif_key=S.KEY_UID)], S.REVIEW, "a"),
    ([candidate("a", 0.9, exif_key=S.KEY_MODEL), candidate("b", 0.89, exif_key=S.KEY_MODEL)], S.REVIEW, "a"),
    ([candidate("a", 0.9, exif_key=S.KEY_MODEL), candidate("b", 0.7, exif_key=S.KEY_MODEL)], S.CERTAIN, "a"),
    ([candidate("a", 0.9, orientation=S.MIRRORED)], S.REVIEW, "a"),
]


def test_decision_table(spark):
    got = decided(spark, {str(k): found for k, (found, *_) in enumerate(CASES)})
    assert [(got[str(k)].verdict, got[str(k)].best and got[str(k)].best.path) for k in range(len(CASES))] == [(v, b) for _, v, b in CASES]
    shown = lambda k: [p.path for p in got[str(k)].runners_up]
    assert shown(2) == ["b"] and shown(4) == ["a"] and shown(5) == ["a"] and shown(8) == ["a", "b"] and shown(9) == ["b"]


def test_larger_versions_and_copies(spark):
    small, large = candidate("small", 0.95, width=800, height=600, unique_id="u", pixels=480_000), candidate("large", 0.94, unique_id="u", pixels=480_000)
    other = candidate("other", 0.2, exif_key=S.KEY_MODEL, pixels=480_000)
    cases = {
        "both": [small, large], "copy": [small | {"identical_file": True}], "low": [small | {"score": 0.7}, large | {"score": 0.69}],
        "keyed": [small | {"exif_key": S.KEY_MODEL}, large | {"exif_key": S.KEY_MODEL, "score": 0.9}, other],
    }
    got = decided(spark, cases)
    assert got["both"].best.path == "large" and got["both"].verdict == S.CERTAIN and got["both"].best.size_ratio == 25 and got["both"].message == ""
    assert got["copy"].verdict == S.REVIEW and got["copy"].message == M.COPY_NOTE
    assert got["low"].verdict == S.REVIEW  # a low score is never raised
    assert (got["keyed"].best.path, got["keyed"].verdict, [p.path for p in got["keyed"].runners_up]) == ("large", S.CERTAIN, ["other"])
    assert "4000×3000" in got["keyed"].best.reason and "25.0" in got["keyed"].best.reason
    assert decided(spark, {"x": cases["copy"]}, allow_same_size=True)["x"].verdict == S.CERTAIN


def test_versions_as_the_columns_tell_them(spark):
    rnd = np.random.RandomState(1)
    looks = [([int(x) for x in rnd.randint(-(2**62), 2**62, 4)], rnd.rand(64).tolist(), (rnd.rand(48) * 255).tolist()) for _ in range(2)]
    rows = []
    for k in range(60):
        dhash, gray, tiles = looks[rnd.randint(2)]
        flip = lambda v: [v[0] ^ int(rnd.randint(0, 2) * (2**30 - 1)), *v[1:]]
        text = lambda *values: values[rnd.randint(len(values))]
        visible = rnd.rand() < 0.8
        rows.append((
            "q", k + 1, f"p{k}", text(None, "", "u", "v"), text(None, "", "t1", "t2"), text("", "1", "2"), text(None, "m", "n"), text(800, 801, 900), 600,
            flip(dhash) if visible else None, [g + 0.02 * rnd.rand() for g in gray] if visible else None, tiles if visible else None,
        ))
    shape = "query_id string, nth int, path string, unique_id string, taken_at string, subsec string, model string, width int, height int, dhash array<bigint>, gray array<double>, tiles array<double>"
    df = spark.createDataFrame(rows, shape)
    a, b = (df.select(F.struct(*M.LOOK).alias(n), F.col("nth").alias(f"n{n}")) for n in "ab")
    same = {(r.na, r.nb) for r in a.crossJoin(b).filter(S.same_photo("a", "b")).select("na", "nb").collect()}
    want, leaders = {}, []
    for k in range(1, 61):
        want[f"p{k - 1}"] = next((lead for lead in leaders if (lead, k) in same), k)
        leaders += [k] * (want[f"p{k - 1}"] == k)
    assert {r.path: r.version for r in M.version_groups(df).collect()} == want and 3 < len(leaders) < 60


def test_two_pictures_do_not_share_an_original(spark):
    slot = lambda n, score, *others: ("d", n, ("a", score), [(p, 0.5) for p in others], S.CERTAIN, "")
    pick = "struct<path: string, score: double>"
    shape = f"doc string, doc_order int, best {pick}, runners_up array<{pick}>, verdict string, message string"
    run = lambda *slots, **how: sorted(M.assign_exclusive(spark.createDataFrame(slots, shape), **how).collect(), key=lambda r: r.doc_order)
    done = run(slot(0, 0.9, "b"), slot(1, 0.95), slot(2, 0.8, "a", "c"))
    assert [d.best.path for d in done] == ["b", "a", "c"] and [len(d.runners_up) for d in done] == [0, 0, 0]
    done = run(slot(0, 0.9, "b"), slot(1, 0.95), slot(2, 0.8, "a", "c"), to_the_end=False)
    assert [d.best.path for d in done] == ["b", "a", "a"] and [d.verdict for d in done] == [S.REVIEW, S.CERTAIN, S.REVIEW] and done[0].message and not done[1].message
    done = run(slot(0, 0.9), slot(1, 0.8), slot(2, 0.9, "x"))
    assert [d.verdict for d in done] == [S.CERTAIN, S.NOT_FOUND, S.REVIEW]


def test_exclusive_as_deferred_acceptance(spark):
    """Against one proposal at a time; and no two slots of a document end with one original."""
    rnd = np.random.RandomState(8)
    slots = []
    for doc in range(12):
        for n in range(int(rnd.randint(1, 9))):
            paths = rnd.permutation(6)[: rnd.randint(1, 5)]
            picks = [(f"p{p}", float(rnd.randint(5)) / 4) for p in paths]
            slots.append((f"d{doc}", n, picks[0] if rnd.rand() < 0.9 else None, picks[1:], S.CERTAIN, ""))
    want = {}
    for doc in {s[0] for s in slots}:
        choices = {n: [best, *rest] if best else [] for d, n, best, rest, *_ in slots if d == doc}
        held, at, waiting = {}, dict.fromkeys(choices, 0), sorted(choices)
        while waiting:
            n = waiting.pop()
            if at[n] >= len(choices[n]):
                continue
            path, score = choices[n][at[n]]
            rival = held.get(path)
            if rival is None or (-score, n) < (-choices[rival][at[rival]][1], rival):
                held[path] = n
                waiting += [] if rival is None else [rival]
                if rival is not None:
                    at[rival] += 1
            else:
                at[n] += 1
                waiting.append(n)
        want |= {(doc, n): next((p for p, h in held.items() if h == n), None) for n in choices}
    pick = "struct<path: string, score: double>"
    df = spark.createDataFrame(slots, f"doc string, doc_order int, best {pick}, runners_up array<{pick}>, verdict string, message string")
    assert {(r.doc, r.doc_order): r.best and r.best.path for r in M.assign_exclusive(df).collect()} == want


def test_best_pairs_as_one_pass_in_order(spark):
    rnd = np.random.RandomState(11)
    rows = [(int(rnd.randint(5)), int(rnd.randint(12)), int(rnd.randint(9)), int(rnd.randint(4)), n, bool(rnd.rand() < 0.2)) for n in range(400)]
    df = spark.createDataFrame(rows, "t int, a int, b int, score int, n int, shared boolean").repartition(3)
    got = {r.n for r in best_pairs(df, ["t", "a"], ["t", "b"], [F.desc("score"), F.col("n")], "shared").collect()}
    want, left, right = set(), set(), set()
    for t, a, b, _, n, shared in sorted(rows, key=lambda r: (-r[3], r[4])):
        if (t, a) not in left and (shared or (t, b) not in right):
            want.add(n)
            left.add((t, a))
            right |= set() if shared else {(t, b)}
    assert got == want
    assert best_pairs(df.limit(0), ["t", "a"], ["t", "b"], [F.col("n")]).count() == 0


@pytest.mark.parametrize("side, grid, channels", [(8, 4, 1), (12, 3, 3), (256, 32, 3)])
def test_refined_score_as_arrays(spark, side, grid, channels):
    rnd = np.random.RandomState(1)
    a = rnd.randint(0, 256, (side, side, channels))
    spoilt = a.copy()
    spoilt[: side // 4, : side // 4] //= 3
    rows = [(f"x{n}", a.ravel().tolist(), b.ravel().tolist()) for n, b in enumerate([a, spoilt, rnd.randint(0, 256, a.shape), a * 0 + 7])] + [("none", None, a.ravel().tolist())]
    closer = spark.createDataFrame([("q", *r) for r in rows], "query_id string, path string, a array<smallint>, b array<smallint>")
    found = spark.createDataFrame([("q", r[0], 0.9) for r in rows] + [("q", "other", 0.5)], "query_id string, path string, score double")
    got = {r.path: (r.score, r.refined) for r in M.refine(found, closer, side, grid, channels).collect()}
    for path, x, y in rows[:-1]:
        x, y = (np.array(v, "f8").reshape(side, side, channels) for v in (x, y))
        step = side // grid
        worst = np.abs(x - y).mean(2).reshape(grid, step, grid, step).mean((1, 3)).max()
        u, v = x.mean(2) - x.mean(), y.mean(2) - y.mean()
        n = np.linalg.norm(u) * np.linalg.norm(v)
        ncc = (u * v).sum() / n if n > 1e-6 else 0.0
        assert got[path] == (pytest.approx(0.27 + 0.7 * max(0.0, ncc - min(0.4, worst / 120))), True)
    assert got["none"] == (0.9, False) and got["other"] == (0.5, False) and got["x0"][0] > got["x1"][0] + 0.05


def test_close_look_separates(spark):
    cases = {
        "near": [candidate("a", 0.9), candidate("b", 0.89), candidate("c", 0.2)], "far": [candidate("a", 0.9), candidate("b", 0.5)],
        "keys": [candidate("a", 0.9, exif_key=S.KEY_MODEL), candidate("b", 0.89, exif_key=S.KEY_MODEL), candidate("c", 0.89)],
        "named": [candidate("a", 0.9, name_match=True), candidate("b", 0.89)],
    }
    found, _ = found_of(spark, cases)
    got = sorted((r.query_id, r.path) for r in M.ties(found).collect())
    assert got == [("keys", "a"), ("keys", "b"), ("near", "a"), ("near", "b"), ("near", "c")]


# --------------------------------------------------------------------------- placement


def test_folders(spark):
    docs = [f"/in/{n}.hwp" for n in ("나주_001 조사", "2031 강변리 지석묘군3 자료", "가 나", "없음", "보고서 12 최종본입니다 정말로요", "이름다른파일")]
    folders = ["나주_002 조사", "지석묘군3", "가나", "보고서 12 최종본입니다 정말로용", "나주_026"]
    fields = spark.createDataFrame([("/in/이름다른파일.hwp", "도면 명칭", "나주_026")], "doc string, key string, value string")
    rows = placement.resolve_folders(spark.createDataFrame([(d,) for d in docs], "doc string"), fields, spark.createDataFrame([(f,) for f in folders], "folder string"), "/out").collect()
    got = {r.doc[4:-4]: (r.folder[5:], r.created) for r in rows}
    assert got["나주_001 조사"] == ("나주_001 조사", True) and got["2031 강변리 지석묘군3 자료"] == ("지석묘군3", False) and got["가 나"] == ("가나", False)
    assert got["없음"] == ("없음", True) and got["보고서 12 최종본입니다 정말로요"] == ("보고서 12 최종본입니다 정말로용", False) and got["이름다른파일"] == ("나주_026", False)


def test_names_are_numbered(spark):
    slots = spark.createDataFrame([("d.hwp", k, c, "구") for k, c in enumerate(["전경", "근경", "근경", "", "a/b"], 1)], "doc string, doc_order int, caption string, band string")
    none = spark.createDataFrame([("d.hwp", "도면 명칭", "나주")], "doc string, key string, value string")
    names = lambda **k: [r.name for r in placement.plan_names(slots, none, **k).orderBy("doc_order").collect()]
    assert names() == ["전경", "근경(1)", "근경(2)", "사진", "ab"]
    assert names(template="{도면명칭}_{번호}_{이름}")[:2] == ["나주_01_전경", "나주_02_근경(1)"]


def test_targets_do_not_collide(spark):
    plan = spark.createDataFrame([("d", k, "/o", "a", ".jpg", "/o/a.jpg") for k in range(3)] + [("d", 9, "/o", "b", ".jpg", None)], "doc string, doc_order int, directory string, stem string, suffix string, target string")
    got = sorted(r.target or "" for r in placement.free_targets(plan, spark.createDataFrame([("/o/a.jpg",), ("/o/a-3.jpg",)], "target string")).collect())
    assert got == ["", "/o/a-2.jpg", "/o/a-4.jpg", "/o/a-5.jpg"]


def test_targets_of_different_names_do_not_collide(spark):
    shape = "doc string, doc_order int, directory string, stem string, suffix string, target string"
    free = lambda stems, there=(): {
        r.doc_order: r.target.removeprefix("/o/") for r in placement.free_targets(
            spark.createDataFrame([("d", k, "/o", s, ".jpg", f"/o/{s}.jpg") for k, s in enumerate(stems)], shape),
            spark.createDataFrame([(f"/o/{s}",) for s in there], "target string"),
        ).collect()
    }
    assert free(["a", "a", "a-2"]) == {0: "a.jpg", 1: "a-2.jpg", 2: "a-2-2.jpg"}
    assert free(["a-2", "a", "a"]) == {0: "a-2.jpg", 1: "a.jpg", 2: "a-3.jpg"}
    assert free(["a", "a", "a-2", "a", "a-2"], ["a.jpg", "a-3.jpg", "other", "b-x.jpg"]) == {0: "a-2.jpg", 1: "a-4.jpg", 2: "a-2-2.jpg", 3: "a-5.jpg", 4: "a-2-3.jpg"}
    many = free(["x"] * 1500)
    assert len(set(many.values())) == 1500 and many[1499] == "x-1500.jpg"


# --------------------------------------------------------------------------- folder names


def test_names_inside_as_brute_force(spark):
    rnd = np.random.RandomState(5)
    word = lambda n: "".join(rnd.choice(list("ab가 나-1"), n))
    texts = {word(int(rnd.randint(0, 30))) for _ in range(120)} | {"", "x", "abc"}
    names = {word(int(rnd.randint(0, 6))) for _ in range(60)} | {"", "x", "abcd", "bc"} | {t[3:9] for t in texts}
    got = N.inside(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(n,) for n in names], "n string"), "t", "n")
    want = {(t, n) for t in texts for n in names if n and n in t}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 300


def test_close_names_as_brute_force(spark):
    import difflib

    rnd = np.random.RandomState(6)
    names = {"".join(rnd.choice(list("abcdef가나다 -12"), int(rnd.randint(1, 40)))) for _ in range(150)} | {"a", "aa", "aaaaaaaaaaaa", "abababababab"}
    texts = set(names)
    for n in names:
        for _ in range(3):
            t = list(n)
            for _ in range(int(rnd.randint(0, 1 + len(t) // 5))):
                at = int(rnd.randint(len(t) + 1))
                t[at : at + int(rnd.randint(2))] = list(rnd.choice(list("abx가"), int(rnd.randint(3))))
            texts.add("".join(t))
    met = N.close_candidates(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(n,) for n in names], "n string"), "t", "n")
    ratio = lambda n, t: difflib.SequenceMatcher(None, n, t).ratio()
    pairs = {tuple(r) for r in met.collect()}
    want = {(t, n): ratio(n, t) for t in texts for n in names if t and ratio(n, t) >= N.CLOSE}
    assert set(want) <= pairs and len(want) > 300 and len(pairs) < len(texts) * len(names) // 4
    rated = spark.createDataFrame(list(want), "t string, n string").select("t", "n", T.name_ratio("n", "t").alias("r")).collect()
    assert all(r.r == want[r.t, r.n] for r in rated)


def folders_in_order(docs, fields, folders):
    """A folder for each document, one after the other; what one makes is there for the next."""
    import difflib

    loose = lambda t: re.sub(r"\s+", "", t.lower())
    digits = lambda t: {int(x) for x in re.findall(r"\d+", t)}
    agree = lambda f, v: not digits(f) and not digits(v) or bool(digits(f)) and bool(digits(v)) and digits(f) <= digits(v)
    there, made, out = sorted(folders), [], {}
    for doc in sorted(docs):
        stem = doc.rsplit("/", 1)[-1].removesuffix(".hwp")
        values = [stem, *[fields[doc][f] for f in placement.FOLDER_FIELDS if f in fields.get(doc, {})]]
        every = there + made
        found = next((f for v in values for f in every if loose(f) == loose(v) and agree(f, v)), None)
        if found is None:
            inner = sorted((f for f in every if loose(f) and loose(f) in loose(stem) and agree(f, stem)), key=lambda f: -len(f))
            found = inner[0] if inner else None
        for v in values if found is None else []:
            near = difflib.get_close_matches(v, [f for f in every if agree(f, v)], n=3, cutoff=0.90)
            if near:
                found = near[0]
                break
        new = T.safe_name(stem)
        out[doc] = (found or new, found is None)
        made += [new] * (found is None)
    return out


def test_folders_as_one_after_the_other(spark):
    rnd = np.random.RandomState(12)
    bases = ["서원 담장", "옛 우물터", "고분 북벽 자료", "산성 서문 조사 보고 자료", "성곽 남쪽 사진 모음 자료집"]
    docs = {}
    for k in range(140):
        name = bases[rnd.randint(5)]
        for _ in range(int(rnd.randint(3))):
            at = int(rnd.randint(len(name)))
            name = name[:at] + str(rnd.choice(["", "가", " ", "ab", "나"])) + name[at + int(rnd.randint(2)) :]
        name = name.strip() + str(rnd.choice(["", "", f" {rnd.randint(4)}", " 추가분"]))
        docs[f"/in/{rnd.randint(10)}/{name.strip() or 'x'}.hwp"] = None
    fields = {d: {str(rnd.choice(placement.FOLDER_FIELDS)): bases[rnd.randint(5)] + str(rnd.choice(["", " 1"]))} for d in docs if rnd.rand() < 0.2}
    folders = ["서원 담장 2", "우물"]
    rows = [(d, k, v) for d, f in fields.items() for k, v in f.items()]
    got = placement.resolve_folders(spark.createDataFrame([(d,) for d in docs], "doc string"), spark.createDataFrame(rows, "doc string, key string, value string"), spark.createDataFrame([(f,) for f in folders], "folder string"), "/out").collect()
    want = folders_in_order(docs, fields, folders)
    found = {r.doc: (r.folder.removeprefix("/out/"), r.created) for r in got}
    assert {d: (found[d], want[d]) for d in want if found[d] != want[d]} == {} and set(found) == set(want)
    assert 5 < sum(c for _, c in want.values()) < len(docs) - 20


# --------------------------------------------------------------------------- buckets


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    import glob
    import os

    target, work, schema = f"{tmp_path}/table", f"{tmp_path}/work", "path string, n int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{target}/bucket=*/*.parquet")}
    rows = {f"p{i}": i for i in range(200)}
    assert merge.read_buckets(spark, target, schema).count() == 0
    written = merge.merge(spark, target, schema, "path", frame(list(rows.items())), frame([]), work, 16)
    assert written == list(range(16))
    before = files()
    touched = merge.merge(spark, target, schema, "path", frame([("p3", -3), ("new", 1)]), frame([("p7", 0), ("none", 0)]), work, 16)
    rows = {k: v for k, v in rows.items() if k != "p7"} | {"p3": -3, "new": 1}
    assert {r.path: r.n for r in merge.read_buckets(spark, target, schema).collect()} == rows
    after, number = files(), lambda f: int(re.search(r"bucket=(\d+)", f)[1])
    assert len(touched) < 6 and {f for f in before if number(f) not in touched} == {f for f in after if number(f) not in touched}
    assert all(after[f] == before[f] for f in before if number(f) not in touched) and not {f for f in before if number(f) in touched} & set(after)
    everything = frame([(k, 0) for k in rows])
    merge.merge(spark, target, schema, "path", frame([]), everything, work, 16)
    assert merge.read_buckets(spark, target, schema).count() == 0 and not os.listdir(work)
    assert merge.merge(spark, target, schema, "path", frame([]), frame([]), work, 16) == []
