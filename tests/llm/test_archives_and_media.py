import gzip
import hashlib
import io
import json
import random

import numpy as np
import pytest

from tesserae.llm import queries as Q
from tesserae.llm import warc, webp

# --------------------------------------------------------------------------- warc


def test_archives_as_brute_force(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    extra = [(1000, pages[0][1]), (1001, "short"), (1002, "short"), (999, pages[0][1]), (1003, "x" * 100), (1004, "x" * 100), (1005, "ü" * 50), (1006, "ü" * 50)]
    both = pages + extra
    df = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in both], "page_id long, url string, html string")
    first = {}
    for i, h in sorted(both):
        first.setdefault(h, i)
    rows = {r.page_id: r for r in warc.read_archives(warc.archive(df)).collect()}
    for i, h in both:
        raw = h.encode()
        revisit = len(raw) >= 100 and first[h] != i
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), hashlib.sha256(raw).hexdigest(), f"http://h/{i}")
        assert (r.record_type, r.refers_to) == (("revisit", first[h]) if revisit else ("response", None))
        assert (r.payload is None) == revisit and (revisit or bytes(r.payload) == raw)
    assert len(rows) == len(both)


def _records(n):
    rnd = random.Random(n)
    return [warc.page_record(i, f"http://h/{i}", bytes(rnd.randrange(256) for _ in range(rnd.randrange(5000))) + b"\r\n\r\nWARC/1.1\r\n", "0" * 64, None) for i in range(n)]


@pytest.mark.parametrize("split", [None, 1, 3])
def test_normalised_files_have_a_member_per_record(tmp_path, split):
    records = _records(20)
    raw = b"".join(records)
    source = tmp_path / "a.mono.warc.gz"
    if split is None:
        source.write_bytes(gzip.compress(raw))
    else:  # members that cut records anywhere
        cuts = [raw[k : k + len(raw) // (7 * split)] for k in range(0, len(raw), len(raw) // (7 * split))]
        source.write_bytes(b"".join(map(gzip.compress, cuts)))
    target = f"file://{tmp_path}/a.warc.gz"
    assert warc.normalise(f"file://{source}", target) == 20
    data = (tmp_path / "a.warc.gz").read_bytes()
    assert gzip.decompress(data) == raw
    index = [json.loads(x) for x in (tmp_path / "a.warc.gz.idx").read_text().splitlines()]
    for rec, (offset, length, uri, kind) in zip(records, index, strict=True):
        assert gzip.decompress(data[offset : offset + length]) == rec and kind == "response" and uri.startswith("<urn:page:")


def test_cut_archives_are_told(tmp_path):
    raw = b"".join(_records(3))
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(gzip.compress(raw[:-50])))))
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")


# --------------------------------------------------------------------------- webp: a writer of everything the format has


def _predict(mode, left, top, top_right, corner):
    avg = lambda a, b: (a + b) // 2
    if mode == 11:
        pl, pt = np.abs(top - corner).sum(), np.abs(left - corner).sum()
        return left if pl < pt else top
    return {
        0: np.array([255, 0, 0, 0]), 1: left, 2: top, 3: top_right, 4: corner, 5: avg(avg(left, top_right), top), 6: avg(left, corner), 7: avg(left, top),
        8: avg(corner, top), 9: avg(top, top_right), 10: avg(avg(left, corner), avg(top, top_right)), 12: np.clip(left + top - corner, 0, 255),
        13: np.clip(avg(left, top) + np.trunc((avg(left, top) - corner) / 2).astype(int), 0, 255),
    }[mode]


def forward_predictor(px, modes, block):
    height, width, _ = px.shape
    out = np.zeros_like(px)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = px[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                guess = px[y - 1, 0]
            else:
                right = px[y - 1, x + 1] if x + 1 < width else px[y, 0]
                guess = _predict(modes[y >> block][x >> block], px[y, x - 1], px[y - 1, x], right, px[y - 1, x - 1])
            out[y, x] = px[y, x] - guess & 255
    return out


def forward_cross(px, factors, block):
    s8 = lambda v: v - 256 if v > 127 else v
    d = lambda f, c: s8(f) * s8(c) >> 5
    out = px.copy()
    for y in range(px.shape[0]):
        for x in range(px.shape[1]):
            _, rb, gb, gr = (int(v) for v in factors[y >> block][x >> block])
            _, r, g, b = (int(v) for v in px[y, x])
            out[y, x, 1] = r - d(gr, g) & 255
            out[y, x, 3] = b - d(gb, g) - d(rb, r) & 255
    return out


def _argb(px):
    px = px.reshape(-1, 4).astype(np.int64)
    return (px[:, 0] << 24 | px[:, 1] << 16 | px[:, 2] << 8 | px[:, 3]).tolist()


def _prefix(value):
    """Symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v - ((2 + second) << (top - 1)), top - 1


def put_image(w, argb, width, top=True, cache_bits=0, refs=False, groups=None):
    """Prefix-coded pixels, with a colour cache, back-references and several groups of codes if asked for."""
    tokens, cache, i = [], {}, 0
    key = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(argb):
        run = 0
        if refs:
            for far in (1, 2, width, width + 1, 130):
                n = 0
                while far <= i and i + n < len(argb) and argb[i + n] == argb[i + n - far] and n < 300:
                    n += 1
                if n > run:
                    run, best = n, far
        if run >= 3:
            near = [k + 1 for k, (x, y) in enumerate(webp.NEAR) if max(1, x + y * width) == best]
            tokens.append((i, "ref", run, near[0] if near else best + 120))
            covered = argb[i : i + run]
        elif cache_bits and cache.get(key(argb[i])) == argb[i]:
            tokens.append((i, "cache", key(argb[i]), 0))
            covered = [argb[i]]
        else:
            tokens.append((i, "pixel", argb[i], 0))
            covered = [argb[i]]
        for v in covered:
            if cache_bits:
                cache[key(v)] = v
        i += len(covered)
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    block, group_of, n_groups = 2, lambda i: 0, 1
    if top:
        w.put(1 if groups else 0, 1)
        if groups:
            n_groups = groups
            w.put(block - 2, 3)
            across, down = -(-width >> block), -(-(len(argb) // width) >> block)
            plan = [k % groups for k in range(across * down)]
            put_image(w, [0xFF000000 | g << 8 for g in plan], across, top=False)
            group_of = lambda i: plan[(i // width >> block) * across + (i % width >> block)]
    sizes = [280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40]
    counts = [[np.zeros(n, int) for n in sizes] for _ in range(n_groups)]
    coded = []
    for i, kind, a, b in tokens:
        c, g = counts[group_of(i)], group_of(i)
        if kind == "pixel":
            parts = [(0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)]
            extra = []
        elif kind == "cache":
            parts, extra = [(0, 280 + a)], []
        else:
            (s, x, n), (t, y, m) = _prefix(a), _prefix(b)
            parts, extra = [(0, 256 + s), (4, t)], [(x, n), (y, m)]
        for which, symbol in parts:
            c[which][symbol] += 1
        coded.append((g, parts, extra))
    lengths = [[webp.code_lengths(x if x.any() else np.eye(1, len(x), 0, dtype=int)[0]) for x in c] for c in counts]
    for ls in lengths:
        for x in ls:
            w.code(x)
    codes = [[webp._mirrored(webp.canonical(x), x) for x in ls] for ls in lengths]
    for g, parts, extra in coded:
        for k, (which, symbol) in enumerate(parts):
            if np.count_nonzero(lengths[g][which]) > 1:
                w.put(int(codes[g][which][symbol]), int(lengths[g][which][symbol]))
            if extra:
                w.put(*extra[k])


def image_file(width, height, body):
    w = webp.Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    body(w)
    return webp.riff(w.done())


def picture(width, height, seed, colours=None):
    rnd = np.random.RandomState(seed)
    px = rnd.randint(0, 256, (height, width, 4)).astype(np.int64)
    if colours:
        px = px.reshape(-1, 4)[:colours][rnd.randint(0, colours, (height, width))]
    return px


@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"refs": True}, {"cache_bits": 6, "refs": True}, {"groups": 3}, {"groups": 2, "cache_bits": 3, "refs": True}])
@pytest.mark.parametrize("colours", [None, 3, 1])
def test_decode_codes_references_and_cache(options, colours):
    px = picture(13, 11, 1, colours)
    data = image_file(13, 11, lambda w: (w.put(0, 1), put_image(w, _argb(px), 13, **options)))
    assert (webp.decode(data) == px).all()


@pytest.mark.parametrize("mode", range(14))
def test_decode_predictors(mode):
    px, block = picture(10, 9, mode), 2
    modes = [[mode if (x + y) % 2 else (mode + 5) % 14 for x in range(3)] for y in range(3)]

    def body(w):
        w.put(1 | webp.PREDICTOR << 1, 3)
        w.put(block - 2, 3)
        put_image(w, [0xFF000000 | m << 8 for row in modes for m in row], 3, top=False)
        w.put(0, 1)
        put_image(w, _argb(forward_predictor(px, modes, block)), 10)

    assert (webp.decode(image_file(10, 9, body)) == px).all()


def test_decode_colour_transforms_together():
    px, block = picture(12, 7, 4), 2
    factors = np.random.RandomState(5).randint(0, 256, (2, 3, 4))
    factors[..., 0] = 255
    modes = [[11, 12, 13], [5, 10, 1]]
    less_green = px.copy()
    less_green[..., 1] = px[..., 1] - px[..., 2] & 255
    less_green[..., 3] = px[..., 3] - px[..., 2] & 255
    predicted = forward_predictor(less_green, modes, block)
    crossed = forward_cross(predicted, factors, block)

    def body(w):
        w.put(1 | webp.SUBTRACT << 1, 3)
        w.put(1 | webp.PREDICTOR << 1, 3)
        w.put(block - 2, 3)
        put_image(w, [0xFF000000 | m << 8 for row in modes for m in row], 3, top=False)
        w.put(1 | webp.CROSS << 1, 3)
        w.put(block - 2, 3)
        put_image(w, _argb(factors), 3, top=False)
        w.put(0, 1)
        put_image(w, _argb(crossed), 12, refs=True)

    assert (webp.decode(image_file(12, 7, body)) == px).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_decode_palettes(colours):
    width, height = 11, 6
    rnd = np.random.RandomState(colours)
    table = rnd.randint(0, 256, (colours, 4))
    index = rnd.randint(0, colours, (height, width))
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each = 8 >> packed
    across = -(-width >> packed)
    rows = np.zeros((height, across), int)
    for x in range(width):
        rows[:, x >> packed] |= index[:, x] << (x & ((1 << packed) - 1)) * each
    deltas = np.diff(np.vstack([np.zeros((1, 4), int), table]), axis=0) & 255

    def body(w):
        w.put(1 | webp.PALETTE << 1, 3)
        w.put(colours - 1, 8)
        put_image(w, _argb(deltas), colours, top=False)
        w.put(0, 1)
        put_image(w, (0xFF000000 | rows.ravel() << 8).tolist(), across)

    assert (webp.decode(image_file(width, height, body)) == table[index]).all()


@pytest.mark.parametrize("data", [b"", b"RIFF", webp.store(b"a" * 64)[:30], b"RIFF" + b"\0" * 40])
def test_damaged_images_are_told(data):
    with pytest.raises(webp.Damaged):
        webp.decode(data)


@pytest.mark.parametrize("payload", [b"\0" * 64, b"ab" * 64, bytes(range(256)) * 4, b"x" * 64 * 17_000, np.random.RandomState(1).bytes(64 * 500)])
def test_payloads_come_back(payload):
    assert webp.load(webp.store(payload)).tobytes() == payload


def test_code_lengths_stay_under_sixteen():
    lengths = webp.code_lengths(np.array([int(1.7**k) + 1 for k in range(40)]))
    assert lengths.max() <= 15 and (2.0 ** -lengths).sum() == 1


def test_media_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op10_media_columns(spark, sf).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = raw + b"\0" * (-len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert by_text.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_repeats_are_copied_and_read_back():
    rnd = np.random.RandomState(3)
    copied = 0
    for k in range(120):
        pieces = [rnd.choice(list(b"abcde fg"), rnd.randint(1, 300)).astype("u1").tobytes() for _ in range(3)]
        text = b"".join(pieces[rnd.randint(3)][rnd.randint(3) :] for _ in range(rnd.randint(1, 40))) + bytes(rnd.randint(0, 256, rnd.randint(50), "u1"))
        data = np.frombuffer(text, "u1")
        done = 0
        for start, length, far in webp.repeats(data):
            assert done <= start and far <= start and 0 < length <= webp.MOST
            assert all(data[start + i] == data[start + i - far] for i in range(length))
            done, copied = start + length, copied + length
        payload = text + b"\0" * (-len(text) % 64 or 64)
        assert webp.load(webp.store(payload)).tobytes() == payload
    assert copied > 50_000
    line = b"The same line of a text comes again and again, word for word. "
    assert len(webp.store(line * 64)) < len(line) * 3 and webp.load(webp.store(line * 64)).tobytes() == line * 64
    run = b"x" * 6400 + b"ab" * 3200
    assert webp.load(webp.store(run)).tobytes() == run


def test_stored_forms_are_what_the_query_tells(spark, tmp_path):
    import hashlib
    import zlib

    texts = ["short", "again and again " * 400, "", "é" * 77]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in webp.media_features(webp.to_media(df)).collect():
        payload = webp.payload_of(texts[r.doc_id])
        media = webp.store(payload)
        assert (r.media_bytes, r.media_sha256, r.tail_crc32) == (len(media), hashlib.sha256(media).hexdigest(), zlib.crc32(payload[-64:]))
        assert (webp.decode(media)[..., 2].tobytes(), r.payload_sha256) == (payload, hashlib.sha256(payload).hexdigest())
