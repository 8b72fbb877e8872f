import itertools
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import bpe, html_text, licences, line_dedup, near_dedup, packing, quality_model, quality_rules
from tesserae.llm import queries as Q

SPACE = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# --------------------------------------------------------------------------- html


def test_marked_pages_keep_their_article(spark, sf):
    from html import unescape

    rows = Q.op1_html_extraction(spark, sf).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        flat = " ".join(unescape(re.sub(r"<[^>]+>", " ", inside.replace("<b>", ""))).split())
        assert r.text == flat and r.n_chars == len(flat)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a <b>b</b>c<p>d&amp;e&#233;", "a bc d&eé"),
        ("<article>x<div class='ad'>no</div><p>y</p></article><p>z", "x y"),
        ("<nav>menu</nav><main><h1>T</h1>t<br>u<form>f</form></main><footer>f</footer>", "T t u"),
        ("<article>real<section class='comments'><article>reader</article></section></article>", "real"),
        ("<body><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no --><p>1 < 2</p>", "1 < 2"),
        ("<article><p>one<aside>side</aside>two</article>", "one two"),
        ("<article><p class='cookie-notice'>no<p>yes<li>q<li>r", "yes q r"),
        ("<article>a<span hidden>b</span>c <i>d</i>e</article>", "ac de"),
        ("<article><section id='share-prices'>Prices</section><div class='share'>Tweet</div><ul class=comments-list><li>reader</ul>x</article>", "Prices x"),
        ("<article>a<i>b<p>c</i>d</p></article>", "ab cd"),
        ("<p>x</b></b>y</div>z", "xy z"),
        ("<article>a <a href='x>y</a> c</article>", "a y c"),
        ("a < b <3 <!doctype html>c", "a < b <3 c"),
        ("", ""),
    ],
)
def test_blocks(html, text):
    assert " ".join(html_text.blocks(html)[1]) == text


def test_host_runs_are_boilerplate(spark):
    menu = "home news sports culture travel contact imprint"
    pages = [(i, f"http://host.example/{i}", f"<body><div>{menu}</div><div>unique story number {i} with words{i} told{i} once{i} only{i}</div></body>") for i in range(6)]
    pages += [(10, "http://other.example/1", f"<body><div>{menu}</div></body>"), (11, "http://host.example/0", pages[0][2])]
    rows = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in rows}
    assert all(text[i] == f"unique story number {i} with words{i} told{i} once{i} only{i}" for i in range(6))
    assert text[10] == menu and text[11] == text[0]


def suffix_array_cover(streams, least):
    """Places of each stream inside a substring of that many tokens that another stream has: by a plain suffix array."""
    suffixes = sorted((s[i:], k, i) for k, s in enumerate(streams) for i in range(len(s)))
    covered = [set() for _ in streams]
    for a, (x, k, i) in enumerate(suffixes):
        for step in (-1, 1):
            b, common = a + step, len(x)
            while 0 <= b < len(suffixes) and common >= least:
                y, other, _ = suffixes[b]
                common = min(common, next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))  # noqa: B905
                if other != k and common >= least:
                    covered[k] |= set(range(i, i + common))
                    break
                b += step
    return covered


def test_prefix_groups_cover_what_a_suffix_array_does():
    import random

    rnd = random.Random(4)
    streams = [[rnd.choice("abc") for _ in range(60)] for _ in range(6)]
    groups = defaultdict(set)
    for k, s in enumerate(streams):
        for x in html_text._stream([" ".join(s)])[0]:
            groups[x].add(k)
    want = suffix_array_cover(streams, html_text.RUN)
    for k, s in enumerate(streams):
        covered = {i + d for i, x in enumerate(html_text._stream([" ".join(s)])[0]) if len(groups[x]) > 1 for d in range(html_text.RUN)}
        assert covered == want[k]
    assert any(want) and not all(len(w) == 60 for w in want)


def test_articles_without_marks(spark):
    """What repeats on many pages of a host goes, copied articles stay."""
    import random

    rnd = random.Random(8)
    word = lambda: "w" + str(rnd.randrange(10**6))
    menu, note = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(9))
    body = [[" ".join(word() for _ in range(rnd.randrange(8, 40))) for _ in range(4)] for _ in range(20)]
    body += [list(body[0]), [*body[1][:3], body[1][3] + " " + word()]]  # a copy and a near copy
    html = [f"<div>{menu}</div>" + "".join(f"<p>{p}</p>" for p in b) + f"<div>{note} {k}</div>" for k, b in enumerate(body)]
    pages = [(k, "http://h.example/" + str(k), h) for k, h in enumerate(html)]
    lead = " ".join(word() for _ in range(30))
    pages += [(100, None, html[0]), (101, "http://h.example/m", f"<article><p>{lead}</p><div class='share-this'>{note} 1</div><div class='share-prices'>{word()} {word()}</div></article>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == " ".join(b) for k, b in enumerate(body))
    assert got[100].startswith(menu) and got[101].startswith(lead + " w") and note not in got[101]


def test_suffix_order_counts_as_brute_force():
    import random

    import numpy as np

    rnd = random.Random(5)
    streams = [" ".join(rnd.choice("abc") for _ in range(n)) for n in (60, 60, 5, 1, 6, 80, 40)]
    words = [s.split() for s in streams]
    runs = [[tuple(w[i : i + html_text.RUN]) for i in range(len(w) - html_text.RUN + 1)] for w in words]
    keys, per = html_text._prefixes(streams)
    owner = np.repeat(np.arange(len(per)), per)
    order, pages = html_text.suffix_order(keys, owner)
    flat = [x for r in runs for x in r]
    assert per.tolist() == [len(r) for r in runs] and (np.diff(keys[order].astype("f8")) >= 0).all()
    assert {(int(owner[i]), flat[i]): int(n) for i, n in zip(order, pages, strict=True)} == {(k, x): sum(x in r for r in runs) for k, r in enumerate(runs) for x in r}
    assert pages.max() > 1 and len(html_text._prefixes(["", "a"])[0]) == 0


def test_suffix_order_holds_every_page_of_the_host(spark, sf, monkeypatch):
    """What marked pages have counts for others' open blocks. A host in many ranges gets the same result."""
    note = "follow all our channels and never miss a story again"
    pages = [(k, f"http://h.example/{k}", f"<article><p>story {k} alone has words{k} like{k} these{k}</p><p>{note}</p></article>") for k in range(4)]
    pages += [(9, "http://h.example/9", f"<article><p>lead of its own that none but this has</p><div class='share-this'>{note}</div></article>")]
    pages += [(10, "http://h.example/10?copy", pages[4][2]), (11, None, pages[4][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    given = spark.read.parquet(f"{sf}/pages.parquet").withColumn("html", F.regexp_replace("html", "</?article>", ""))
    ask = lambda x: sorted((r.page_id, r.url or "", r.text) for r in html_text.extract(x).collect())
    got, unmarked = ask(df), ask(given)
    text = {r[0]: r[2] for r in got}
    assert all(text[k].endswith(note) for k in range(4))
    assert text[9] == text[10] == "lead of its own that none but this has"
    assert text[11] == f"lead of its own that none but this has {note}"
    monkeypatch.setattr(html_text, "HOST_BYTES", 50)
    assert ask(df) == got and ask(given) == unmarked


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000 + '"', "<div>" * 100_000 + "</p>" * 100_000, "<b>" * 100_000 + "<div></div>" * 100_000, "<b><p>" * 50_000 + "</b>" * 100_000, "<!--" * 200_000, "<script>" * 100_000, "<p '\"" * 150_000, "<" * 10**6],
    ids=range(8),
)
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 3


def test_unique_runs_stay():
    assert html_text.keep_unique(["a b c", "d e f g h i"], range(0)) == ["a b c", "d e f g h i"]
    assert html_text.keep_unique(["a b c d e f", "x y"], [0]) == ["x y"]
    assert html_text.keep_unique(["a b c d e f"], [0]) == ["a b c d e f"]


# --------------------------------------------------------------------------- lines


def plain_line_dedup(texts):
    seen, exact, out, near = set(), set(), {}, 0
    for i in sorted(texts):
        kept = []
        for line in (texts[i] or "").split("\n"):
            w = line.encode().split()
            whole = b" ".join(w)
            if len(w) < line_dedup.MIN_WORDS:
                kept.append(line)
                continue
            gone = whole in exact
            if len(w) >= line_dedup.MIN_NEAR:
                forms = {whole, *(b" ".join(w[:k] + w[k + 1 :]) for k in range(len(w)))}
                near += not gone and not seen.isdisjoint(forms)
                gone = gone or not seen.isdisjoint(forms)
                seen |= forms
            exact.add(whole)
            if not gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out, near


def test_lines_as_brute_force(spark, docs, texts):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    w = base.split()
    forms = [base, " ".join(w[1:]), " ".join(w[:-1]), " ".join([*w[:4], "new", *w[5:]]), " ".join([*w, "more"]), " ".join([*w[:3], "x", *w[3:]]), " ".join(w[2:]), " ".join([*w[:2], "p", "q", *w[4:]])]
    made = {10_000 + i: f"{f}\nThe." for i, f in enumerate(forms)}
    both = texts | made
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    want, near = plain_line_dedup(both)
    got = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(df).collect()}
    assert got == want and near > 5


def test_words_of_lines(monkeypatch):
    import random

    rnd = random.Random(2)
    texts = ["", "\n", " a\n\n b", "x", "日本 語ab\nthe", "a\tb\x0bc\r", "long" * 40, "é é", "\n\n"] + ["".join(rnd.choice("ab \n\té日") for _ in range(rnd.randrange(30))) for _ in range(300)]
    want = []
    for i, t in enumerate(texts):
        for k, line in enumerate(t.encode().split(b"\n")):
            w = line.decode().replace("日", " 日 ").replace("本", " 本 ").replace("語", " 語 ").encode().split()
            want += [(i, k, w)] if w else []
    whole = pa.array(["not this", *texts, "nor this"])[1:-1]
    for window in (1 << 20, 7):
        monkeypatch.setattr(line_dedup, "WINDOW", window)
        hashes, counts, text, number = line_dedup.lines_of(whole)
        assert list(zip(text.tolist(), number.tolist(), counts.tolist(), strict=True)) == [(i, k, len(w)) for i, k, w in want]
        by_word, by_hash = defaultdict(set), defaultdict(set)
        for w, h in zip([x for *_, w in want for x in w], hashes.tolist(), strict=True):
            by_word[w].add(h)
            by_hash[h].add(w)
        assert all(len(v) == 1 for v in [*by_word.values(), *by_hash.values()])
        same = defaultdict(set)
        for (*_, w), h in zip(want, line_dedup.line_hashes(hashes, counts).tolist(), strict=True):
            same[h].add(tuple(w))
        assert all(len(v) == 1 for v in same.values())
    assert len(line_dedup.lines_of(pa.array([], pa.string()))[1]) == 0


def test_short_lines_and_scripts_without_spaces(spark):
    rows = [(1, "click here\n春の海ひねもすのたりのたりかな\nMonday"), (2, "Click here\nclick  here\n春の海ひねもすのたりのたりかも\n春の山"), (3, "Monday\n\nTuesday"), (None, "Monday")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(df).collect()}
    assert got == {1: rows[0][1], 2: "Click here\n春の山", 3: "\nTuesday", None: "Monday"}
    equal = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(df, near=False).collect()}
    assert equal[2] == "Click here\n春の海ひねもすのたりのたりかも\n春の山" and equal[3] == "\nTuesday"


def test_match():
    a = "a b c d e f g h".split()
    assert line_dedup.match(a, a) and line_dedup.match(a, a[1:]) and line_dedup.match(a[:-1], a[1:])
    assert line_dedup.match(a, ["a", "b", "x", *a[3:]]) and line_dedup.match(a[:4] + ["n"] + a[4:], a)
    assert not line_dedup.match(a, a[2:]) and not line_dedup.match(a, ["x", "y", *a[2:]])


def test_matching_lines_share_a_sample_key():
    import random

    rnd = random.Random(7)
    for _ in range(300):
        a = [str(rnd.randrange(rnd.choice((3, 50, 5000)))).encode() for _ in range(rnd.randrange(8, 60))]
        b = list(a)
        k = rnd.randrange(len(a))
        kind = rnd.randrange(3)
        if kind == 0:
            b[k] = b"new%d" % rnd.randrange(10**6)
        elif kind == 1 and len(a) > 8:
            del b[k]
        else:
            b.insert(k, b"new%d" % rnd.randrange(10**6))
        hashes, counts, *_ = line_dedup.lines_of(pa.array([(b" ".join(a) + b"\n" + b" ".join(b)).decode()]))
        assert counts.tolist() == [len(a), len(b)]
        who, keys = line_dedup.sample_keys(hashes, counts)
        assert set(keys[who == 0]) & set(keys[who == 1])
        number, value = line_dedup.variants(hashes, counts)
        assert set(value[number == 0]) & set(value[number == 1])


# --------------------------------------------------------------------------- licences


def test_licences(spark, docs, texts):
    names = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "all-rights-reserved",
    }
    want = sorted((i, k, names[line]) for i, t in texts.items() for k, line in enumerate(t.split("\n")) if line in names)
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.licences(docs).collect() if r.family != "unknown")
    assert got == want
    odd = [(1, "He renewed his driving license and lost it again."), (2, "A license was needed for the premises.\nReleased under the BSD License."), (3, "permission")]
    rows = licences.licences(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.paragraph): r.family for r in rows if r.family != "unknown"} == {(2, 1): "bsd"}


def plain_licences(text):
    """Every paragraph through the model and all templates, without a filter."""
    model, out = licences.classifier(), {}
    templates = {f"{f}/{k}": (f, licences.grams(licences.words_of(x))) for f, ts in licences.TEMPLATES.items() for k, x in enumerate(ts)}

    def family(paragraph):
        own = licences.grams(licences.words_of(paragraph))
        if len(licences.words_of(paragraph)) < 2:
            return "unknown"
        best, p = model.predict(paragraph)
        sure = any(f == best and (len(own & g) / len(g) >= licences.COVERED or len(own & g) / len(own) >= licences.NEAR) for f, g in templates.values())
        return best if sure and p >= licences.SURE else "unknown"

    lines = text.split("\n")
    k = 0
    while k < len(lines):
        n = next((i for i in range(k, len(lines)) if not lines[i].strip()), len(lines)) - k
        found = {i: family(lines[i]) for i in range(k, k + n)}
        out |= {(i, 1): f for i, f in found.items() if f != "unknown"}
        whole = family("\n".join(lines[k : k + n])) if n > 1 else "unknown"
        if whole != "unknown" and whole not in found.values():
            out[k, n] = whole
        k += max(n, 1)
    return out


def test_licences_as_brute_force(spark, texts):
    import textwrap

    whole = ["\n\n".join(ts[:-1]) for ts in licences.TEMPLATES.values()]
    made = [textwrap.fill(x, width, replace_whitespace=False) for x in whole for width in (30, 72)]
    made += ["CC BY 4.0", "Source Code Form is subject to the terms of the MPL", "Licensed under CC BY-ND 4.0.", "x\n\nCC\nBY\n4.0\n", "all rights x rights reserved", "license", "MIT\nMIT", "a\n" * 5 + "All rights reserved.\n" + "b\n" * 5]
    both = texts | {50_000 + k: x for k, x in enumerate(made)}
    want = {(i, *at): f for i, x in both.items() for at, f in plain_licences(x).items()}
    rows = licences.licences(spark.createDataFrame(list(both.items()), "doc_id long, text string")).collect()
    got = {(r.doc_id, r.paragraph, r.lines): r.family for r in rows if r.family != "unknown"}
    one_word_lines = {k for k in want if k[2] > 1 and all(len(licences.words_of(x)) < 2 for x in both[k[0]].split("\n")[k[1] : k[1] + k[2]])}
    assert got == {k: v for k, v in want.items() if k not in one_word_lines} and len(one_word_lines) <= 1
    wrapped = {f for (i, *_), f in got.items() if 50_000 <= i < 50_000 + 2 * len(whole)}
    assert len(wrapped) > 15 and any(n > 1 for _, _, n in got) and got[50_000 + 2 * len(whole), 0, 1] == "cc-by" and got[50_002 + 2 * len(whole), 0, 1] == "cc-by-nd"


def test_the_filter_follows_from_the_shares():
    import random

    rnd = random.Random(11)
    templates = [licences.words_of(t) for ts in licences.TEMPLATES.values() for t in ts]
    held = 0
    for _ in range(20_000):
        template = rnd.choice(templates)
        words = [w for w in template if rnd.random() > 0.08]
        for _ in range(rnd.randrange(3)):
            words.insert(rnd.randrange(len(words) + 1), "other")
        words = words[: rnd.choice((2, 3, 4, 5, 6, 8, len(words)))] if rnd.random() < 0.5 else words
        own, all_of = licences.grams(words), licences.grams(template)
        if len(words) > 1 and (len(own & all_of) / len(all_of) >= licences.COVERED or len(own & all_of) / len(own) >= licences.NEAR):
            held += 1
            assert licences.may_tell(words)
    assert held > 3_000


def test_licence_scores_as_the_model_gives_them(spark):
    model = licences.classifier()
    lines = [t for ts in licences.TEMPLATES.values() for t in ts] + list(licences.UNKNOWN)
    rows = licences.licences(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    for r in rows:
        family, p = model.predict(lines[r.doc_id])
        assert abs(r.probability - p) < 1e-5 and r.family in (family, "unknown")
    assert sum(r.family == "unknown" for r in rows) <= len(licences.UNKNOWN)


# --------------------------------------------------------------------------- tokens


def test_bpe_as_the_library(spark, docs, texts):
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    odd = ["", " ", "  two  spaces ", "tab\t x\n\n y", "it's we'll 'd", "x<|endoftext|> y<|endoftext|>", "日本語　テスト é ß", "\x1c\x1f a​ b", "a,b c. d! 12 3.5", " x   y", "word. Word, word"]
    both = texts | {10_000 + i: x for i, x in enumerate(odd)}
    df = spark.createDataFrame(list(both.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(df, Q.tokenizer_path(), lexicon_words=500), Q.tokenizer_path()).collect()}
    for i, x in both.items():
        ids = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids and rows[i].n_tokens == len(ids)
        assert rows[i].text == t.decode(ids, skip_special_tokens=False)
    found = {r.doc_id: r for r in Q.op5_bpe(spark, "/root/testdata/sf0.001").collect()}
    raw = np.array(t.encode(texts[min(texts)], add_special_tokens=False).ids, "<u4").tobytes()
    assert found[min(texts)].ids_sha256 == hashlib.sha256(raw).hexdigest()


def test_transducer_is_minimal_and_exact():
    words = {w.encode(): [len(w), i] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "", "é"])}
    lexicon = bpe.Lexicon(bpe.build_lexicon(words))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert lexicon.get(b"ta") is None and lexicon.get(b"tapsx") is None and lexicon.get(b"zebra") is None
    assert lexicon.n_states < sum(len(w) for w in words)
    right = set()
    for w in words:
        for k in range(len(w) + 1):
            right.add(frozenset(v[k:] for v in words if v[:k] == w[:k]))
    assert lexicon.n_states == len(right)  # one state per set of endings


def test_frequent_words_are_counted_over_all_texts(spark):
    df = spark.createDataFrame([("x b a a",), ("y a b",), (None,)], "text string")
    assert bpe.frequent_words(df, 2) == ["a", "b"]


def test_unseen_words_are_merged_at_one_go(monkeypatch):
    """Encoding without a lexicon calls the merge a few times for many words, with the library's ids, also when its memory overflows."""
    import random

    from tokenizers import Tokenizer

    rnd = random.Random(9)
    letters = "abcdeéßж中1.,!-'\u2028\x1c\t"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9)))
    texts = ["".join(word() + rnd.choice([" ", " ", " ", "\n", "\n\n", " \n"]) for _ in range(60)) for _ in range(100)]
    texts += ["\n".join(" ".join(f"w{rnd.randrange(10**6)}x" for _ in range(40)) for _ in range(3)) for _ in range(20)] + ["", " ", "\n", "a\t", "x \ty z\u2028", "it's\nit's", "a <|endoftext|> b"]
    t = Tokenizer.from_file(Q.tokenizer_path())
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for remembered in (bpe.REMEMBERED, 50):
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        encoder = bpe.Encoder(Q.tokenizer_path())
        for batch in (texts, texts[::-1]):
            flat, ends = encoder.encode_all(pa.array(batch))
            got = [flat[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            assert got == [want[texts.index(x)] for x in batch]
    fresh = bpe.Encoder(Q.tokenizer_path())
    monkeypatch.setattr(fresh, "_word", lambda word: pytest.fail("a word was merged alone"))
    fresh.encode_all(pa.array(["one tokenless zzyzxword qqyzzx\nand wordzzq, again"]))


def test_packing(spark, sf, texts):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    rows = Q.op6_packing(spark, sf).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p.length for p in pieces) <= 1024
    assert sum(sum(p.length for p in ps) < 1024 for ps in by_seq.values()) <= 8  # a partition's last one at most


def test_bm25_neighbours_as_brute_force():
    import math

    import numpy as np

    rnd = np.random.RandomState(3)
    docs = [rnd.randint(0, 40, rnd.randint(5, 60)).astype("u2") for _ in range(50)]
    idf = rnd.rand(64).astype("f4") + 0.1
    shard = packing.Shard(docs, idf, 30.0)
    shard.unused[[3, 7]] = False

    def weight(d, term):
        tf = int((d == term).sum())
        return float(idf[term]) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / 30.0)) if tf else 0.0

    for seed in (0, 3, 11):
        query = sorted({int(x) for x in docs[seed]}, key=lambda x: -weight(docs[seed], x))[: packing.QUERY_TERMS]
        score = {k: sum(weight(d, x) for x in query) for k, d in enumerate(docs) if k not in (3, 7)}
        best = sorted((k for k in score if score[k] > 0), key=lambda k: (-score[k], k))[: packing.NEIGHBOURS]
        got = shard.neighbours(seed)
        assert all(math.isclose(score[a], score[b], rel_tol=1e-4) for a, b in zip(got, best, strict=True))


def test_seeds_ask_with_all_ids_and_until_no_neighbour_is_left():
    import numpy as np

    rare, idf = np.arange(100, 130), np.ones(500, "f4")
    docs = [rare, rare[-1:], *(np.array([k]) for k in range(200, 240)), *([np.array([x, 300 + x]) for x in rare])]
    docs = [d.astype("u2") for d in docs]
    assert set(packing.Shard(docs, idf, 2.0).neighbours(0)) == {0, 1, *range(42, 72)}  # thirty ids and more than 24 neighbours
    placed = [p[0] for p in packing.Packer(1000, 0, idf, 2.0).pack(docs)]
    assert set(placed[1:32]) == {1, *range(42, 72)} and placed[32:] == list(range(2, 42))


def test_frequent_ids_count_as_others_do(monkeypatch):
    import numpy as np

    rnd = np.random.RandomState(6)
    docs = [rnd.zipf(1.3, rnd.randint(1, 80)).clip(0, 499).astype("u2") for _ in range(200)]
    idf = rnd.rand(500).astype("f4") + 0.1
    found = []
    for frequent in (1, 16, 1000):
        monkeypatch.setattr(packing, "FREQUENT", frequent)
        shard = packing.Shard(docs, idf, 30.0)
        found.append([shard.neighbours(k) for k in range(200)])
    assert [list(map(set, x)) for x in found[1:]] == [list(map(set, found[0]))] * 2
    assert all(x[:5] == y[:5] for x, y in zip(found[0], found[2], strict=True))


# --------------------------------------------------------------------------- near duplicates


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def components_of(sets):
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in inverted[g] if j < i).items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in sets}


def families(seed=5):
    """Copies of a base with a few words changed: each is close to the base, few are close to each other."""
    import random

    rnd = random.Random(seed)
    out, n = {}, 20_000
    for size, edits in ((40, 3), (25, 2), (12, 6)):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        for k in range(size):
            copy = list(base)
            for _ in range(edits * (k > 0)):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(10**6)}"
            out[n] = " ".join(copy)
            n += rnd.randrange(1, 5)
    return out


@pytest.mark.parametrize("limit, block", [(None, None), (5, 3)])
def test_near_duplicates_as_brute_force(spark, texts, monkeypatch, limit, block):
    if limit:
        monkeypatch.setattr(near_dedup, "FAMILY_CLASSES", limit)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
    both = texts | families() | {30_000: "one two", 30_001: "ONE  two", 30_002: "one two three"}
    sets = sets_of(both)
    want = components_of(sets)
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(both.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in rows} == {i: (c, len(sets[i]), c == i) for i, c in want.items()}
    assert sum(want[i] != i for i in want) > 60


def test_keep_one(spark, docs, texts):
    kept = near_dedup.keep_one(docs)
    want = components_of(sets_of(texts))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}


def loose_pairs(seed=9):
    """Pairs of texts whose similarity is at 0.80, between 0.80 and 0.85, at 0.85 and just under 0.80."""
    import random

    rnd = random.Random(seed)
    out = {}
    for n in range(160):
        base = [f"b{rnd.randrange(10**9)}" for _ in range(94)]  # 90 shingles; a changed tail of k words spoils k
        changed = (10, 9, 8, 7, 11)[n % 5]  # (90 - k) / (90 + k): 0.800, 0.818, 0.837, 0.856, 0.782
        out[40_000 + 2 * n] = " ".join(base)
        out[40_001 + 2 * n] = " ".join([*base[:-changed], *(f"c{rnd.randrange(10**9)}" for _ in range(changed))])
    return out


def loose_components_of(sets):
    """As components_of, at 80 % and over all pairs."""
    label = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("limit, block", [(None, None), (5, 3)])
def test_near_stage_links_from_four_fifths(spark, docs, sf, texts, monkeypatch, limit, block):
    if limit:
        monkeypatch.setattr(near_dedup, "FAMILY_CLASSES", limit)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
    both = texts | families() | loose_pairs()
    sets = sets_of(both)
    made = spark.createDataFrame(list(both.items()), "doc_id long, text string")
    want = {i for i, c in loose_components_of(sets).items() if i == c}
    strict = {i for i, c in components_of(sets).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, made, sf).collect()} == want
    assert len(strict - want) >= 90 and all(40_009 + 10 * k in want for k in range(32))


def test_forest_follows_the_similarity():
    import math

    for percent in (80, 85, 90):
        rule, s = near_dedup.Rule(percent), percent / 100
        missed = (1 - s**near_dedup.BASE_DEPTH) ** rule.trees
        unlike = sum(math.comb(rule.values, k) * s**k * (1 - s) ** (rule.values - k) for k in range(rule.least))
        assert missed <= near_dedup.MISSED and unlike <= near_dedup.UNLIKE


# --------------------------------------------------------------------------- quality


def test_rules_as_brute_force(spark, sf, texts):
    for r in Q.op9_quality_rules(spark, sf).collect():
        w = words_of(texts[r.doc_id])
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often = Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if often[x] > 1 for d in range(5)}
        lines = [x for x in texts[r.doc_id].split("\n") if words_of(x)]
        symbols = len(re.findall(r"[#*$%&|<>]", texts[r.doc_id]))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_ledger_serves_many_policies(spark, docs):
    book = quality_rules.ledger(quality_rules.measure(docs)).cache()
    v1 = quality_rules.POLICIES["v1"]
    rows = {r.rule: r for r in quality_rules.ablation(book, v1).collect()}
    kept = quality_rules.apply_policy(book, v1).filter("kept").count()
    for rule in v1.rules:
        fewer = quality_rules.Policy("less", tuple(r for r in v1.rules if r != rule))
        passing = book.filter(F.col("fail_bits").bitwiseAND(F.lit(fewer.mask)) == 0).count()
        assert passing - kept == rows[rule].fails_alone
    assert quality_rules.apply_policy(book, quality_rules.POLICIES["base"]).filter("kept").count() >= kept


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and len(rows) > 50
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_model_is_a_sum_of_tables():
    import numpy as np

    rnd = np.random.RandomState(0)
    x = rnd.rand(1500, len(quality_model.FEATURES))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # needs the pair
    model = quality_model.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95 and any({i, j} == {0, 1} for i, j, *_ in model.pairs)
    assert quality_model.fit(x[:0], y[:0]) is None
    assert 0 < quality_model.fit(x, np.ones(len(x))).score(x[:1])[0] < 1


# --------------------------------------------------------------------------- the pipeline


def test_pipeline(spark, sf, texts):
    import numpy as np

    pieces = corpus_pipeline.run(spark, sf).collect()
    ids = defaultdict(dict)
    for p in pieces:
        ids[p.doc_id][p.start] = np.frombuffer(p.ids, "<u4").tolist()
    bytes_of = bpe.vocabulary(Q.tokenizer_path()).token_bytes
    left = {i: b"".join(bytes_of[x] for s in sorted(parts) for x in parts[s])[:-1].decode() for i, parts in ids.items()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    scores = {r.doc_id for r in Q.op8_quality_classifier(spark, sf).filter("predicted = 1").collect()}
    lines, _ = plain_line_dedup({i: t for i, t in texts.items() if i in good & scores})
    lines = {i: t for i, t in lines.items() if words_of(t)}  # all of these had words
    reps = components_of(sets_of(lines))
    assert left == {i: t for i, t in lines.items() if reps[i] == i}
