"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import bpe, html_text, licences, line_dedup, near_dedup, packing, quality_model, quality_rules, warc, webp
from tesserae.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 7919} and{i % 13}" for i in range(40_000))
GOOD = "The quick brown fox jumps over the lazy dog, while seven other foxes watch it from the hill."
DOCS = [
    (1, GOOD), (1, GOOD), (2, GOOD), (3, None), (4, ""), (5, " \t\n\x0b "), (6, LONG), (7, LONG + " end"), (None, GOOD), (8, "The."), (9, "Zeile eins\n\nZeile eins"),
]
EXTRA = ["_row", "score", "t", "h", "i", "th", "_th", "_gone", "row", "cls", "ids", "n", "SCORE2", "text_"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, None), (None, 0), (8, 0), (9, 1), (9, 0)], "doc_id long, quality int")


OPERATORS = {
    "rules": quality_rules.quality_rules,
    "bpe": lambda d: bpe.bpe_decode(bpe.bpe_encode(d, tokenizer_path(), lexicon_words=100), tokenizer_path()),
    "near": near_dedup.near_duplicates,
    "lines": line_dedup.drop_duplicate_lines,
    "webp": lambda d: webp.media_features(webp.to_media(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_per_document(docs, name):
    rows = OPERATORS[name](docs).collect()
    assert sorted((r.doc_id or 0) for r in rows) == sorted((i or 0) for i, _ in DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_rules_of_odd_texts(docs):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert [rows[k].n_words for k in (3, 4, 5, 8)] == [0, 0, 0, 1]
    assert all(rows[k].base_failed and not rows[k].kept for k in (3, 4, 5, 8))
    assert rows[1].kept and rows[6].n_words == 80_000


def test_near_duplicates_of_odd_texts(docs):
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert rows[2].component_id == 1 and not rows[2].kept and rows[1].kept
    assert rows[None].component_id == 1
    assert all(rows[k].n_shingles == 0 and rows[k].kept and rows[k].component_id == k for k in (3, 4, 5))
    assert rows[7].component_id == 6 and rows[8].n_shingles == 1


def test_lines_of_odd_texts(docs):
    rows = line_dedup.drop_duplicate_lines(docs)
    assert rows.columns == docs.columns
    texts = {}
    for r in rows.collect():
        texts.setdefault(r.doc_id, []).append((r.text, r.n_chars))
    assert texts[3] == [(None, None)] and texts[4] == [("", 0)] and texts[2] == [("", 0)]
    assert texts[1] == [(GOOD, len(GOOD))] * 2 and texts[None] == [(GOOD, len(GOOD))]
    assert texts[7] == [("", 0)] and texts[9] == [("Zeile eins\n", 11)]


def test_media_of_empty_texts(docs):
    rows = {r.doc_id: r for r in OPERATORS["webp"](docs).collect()}
    assert rows[3].n_bytes == 0 and rows[3].payload_bytes == 64 and rows[3].media_sha256 == rows[4].media_sha256


def test_bpe_of_odd_texts(docs):
    rows = {r.doc_id: r for r in OPERATORS["bpe"](docs).collect()}
    assert rows[3].n_tokens == 0 and rows[3].text == "" and rows[6].text == LONG


def test_packing_of_odd_texts(docs):
    pieces = packing.pack(docs, tokenizer_path(), keep=("lang",)).collect()
    assert sum(p.length for p in pieces if p.doc_id == 3) == 1 and all(p.lang == "en" for p in pieces)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_model_of_odd_labels(docs, labels):
    rows = quality_model.quality_scores(docs, labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert not next(r for r in rows if r.doc_id is None).held_out
    unlabelled = quality_model.quality_scores(docs, labels.limit(0)).collect()
    assert all(r.score == 1 and r.predicted == 1 for r in unlabelled)
    assert quality_model.quality_scores(docs.limit(0), labels).count() == 0
    scored = quality_model.score(docs, None, out_col="other")
    assert scored.columns == [*docs.columns, "other"] and scored.count() == len(DOCS)


def test_licences_of_odd_texts(docs):
    more = docs.select("doc_id", F.concat_ws("\n", "text", F.lit("Released under the MIT License.")).alias("text"))
    rows = licences.licences(more).collect()
    assert len(rows) == len(DOCS) and {r.family for r in rows} == {"mit"}
    assert licences.licences(docs).count() == 0 and licences.licences(docs.limit(0)).count() == 0


PAGES = [(1, "http://a/x", None), (2, None, ""), (3, "http://a/y", f"<p>{LONG}"), (3, "http://a/y", f"<p>{LONG}"), (None, "http://a/z", "<article>x"), (4, "http://b", "<p>short")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "payload", "host", "refers_to")})


def test_pages(pages):
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(PAGES) and {r.page_id: r.text for r in rows}[1] == "" and {r.page_id: r.text for r in rows}[3] == LONG
    assert html_text.extract(pages.limit(0)).count() == 0
    read = warc.read_archives(warc.archive(pages)).collect()
    assert len(read) == len(PAGES) and all(r.record_type == "response" for r in read)
    assert warc.read_archives(warc.archive(pages.limit(0))).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, sf, stage):
    name, work = corpus_pipeline.STAGES[stage]
    out = work(spark, docs, sf)
    if stage < 4:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert work(spark, docs.limit(0), sf).count() == 0


def test_documents_that_lose_all_words_go(spark, docs, sf):
    name, work = corpus_pipeline.STAGES[2]
    assert name == "line dedup"
    got = sorted((r.doc_id or 0, r.text) for r in work(spark, docs, sf).collect())
    want = [(0, GOOD), (1, GOOD), (1, GOOD), (3, None), (4, ""), (5, " \t\n\x0b "), (6, LONG), (8, "The."), (9, "Zeile eins\n")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
