"""Lossless WebP: a decoder of the whole format, and a writer for rows of 8-bit samples.

``decode`` reads prefix codes, back-references and the colour cache, inverts the predictor,
cross-colour, subtract-green and palette transforms, and returns an array of rows x columns x
(alpha, red, green, blue). ``encode`` writes grey images (subtract-green) of literals and back-references to
repeats of ``LEAST`` samples or more. An image without a repeat has literals of one prefix code alone and
takes a vectorised path: the code's length at every bit is looked up at once, only following the chain of
lengths goes step by step.

Payloads are laid out 64 samples to a row, in images of at most 16,384 rows; a longer payload is
several images in a row, each as long as its RIFF size says.

Defined results: null and empty texts are 64 zero bytes; equal texts give equal media; null ids
pass through; repeated rows give repeated results; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tesserae.llm.common import text_of

WIDTH, MAX_ROWS = 64, 16_384
# Repeats: their least and greatest length, how many samples a key covers, and one in how many places is looked up (a power of two).
LEAST, MOST, KEY, SPARSE = 48, 4096, 16, 16

# Fixed values of the format: order of the code-length code's lengths, and near distances (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
PREDICTOR, CROSS, SUBTRACT, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD


class Damaged(ValueError):
    """The bytes are no lossless WebP image."""


# --------------------------------------------------------------------------- prefix codes


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, first bit highest: in the order of length, then symbol."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    share = 1 << (15 - lengths[used])
    codes = np.zeros(len(lengths), "i8")
    codes[used] = (np.cumsum(share) - share) >> (15 - lengths[used])
    return codes


def _reversals() -> np.ndarray:
    value, out = np.arange(1 << 15), np.zeros(1 << 15, "i8")
    for k in range(15):
        out |= (value >> k & 1) << (14 - k)
    return out


_REVERSED = _reversals()


def _mirrored(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return _REVERSED[codes] >> (15 - lengths)


class Code:
    """A prefix code as a table over the next ``bits`` bits: symbols and lengths."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.symbols, self.lengths = 0, np.array([used[0] if len(used) else 0], "u2"), np.zeros(1, "u1")
            return
        self.bits = int(lengths.max())
        if (2.0 ** -lengths[used].astype(float)).sum() != 1.0:
            raise Damaged("a prefix code is not complete")
        self.symbols, self.lengths = np.zeros(1 << self.bits, "u2"), np.zeros(1 << self.bits, "u1")
        start = _mirrored(canonical(lengths), lengths)
        for s, first, n in zip(used.tolist(), start[used].tolist(), lengths[used].tolist(), strict=True):
            self.symbols[first :: 1 << n] = s
            self.lengths[first :: 1 << n] = n


@lru_cache(maxsize=256)
def _known_code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, "i8"))


class Bits:
    def __init__(self, data: bytes) -> None:
        self._data, self.at = data, 0

    def _window(self) -> int:
        at = self.at >> 3
        return int.from_bytes(self._data[at : at + 5], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self._data):
            raise Damaged("the image ends early")
        value = self._window() & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, code: Code) -> int:
        k = self._window() & ((1 << code.bits) - 1)
        self.at += int(code.lengths[k])
        if self.at > 8 * len(self._data):
            raise Damaged("the image ends early")
        return int(code.symbols[k])


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, "i8")
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size:
            raise Damaged("a symbol is out of range")
        lengths[symbols] = 1
        return _known_code(lengths.tobytes())
    own = np.zeros(19, "i8")
    for k in LENGTH_ORDER[: bits.read(4) + 4]:
        own[k] = bits.read(3)
    code = _known_code(own.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
            continue
        n = bits.read(2) + 3 if s == 16 else bits.read(3) + 3 if s == 17 else bits.read(7) + 11
        if at + n > size:
            raise Damaged("code lengths run over")
        lengths[at : at + n] = last if s == 16 else 0
        at += n
    return Code(lengths)


# --------------------------------------------------------------------------- pixels


def _span(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(bits: Bits, code: Code, width: int) -> int:
    far = _span(bits, bits.symbol(code))
    if far > len(NEAR):
        return far - len(NEAR)
    x, y = NEAR[far - 1]
    return max(1, x + y * width)


def _pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as packed ARGB values."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, meta = 1, 0, None
    if top and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        meta = _pixels(bits, across, -(-height >> block), False) >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    if meta is None and not cache_bits and all(not c.bits for c in codes[0][1:4]) and codes[0][0].symbols.max() < 256:
        green, red, blue, alpha, _ = codes[0]
        fixed = int(alpha.symbols[0]) << 24 | int(red.symbols[0]) << 16 | int(blue.symbols[0])
        return _literals(bits, green, total).astype("u4") << 8 | np.uint32(fixed)
    if meta is None and not cache_bits and all(not c.bits for c in codes[0][1:4]) and codes[0][0].bits:
        green, red, blue, alpha, far = codes[0]
        fixed = int(alpha.symbols[0]) << 24 | int(red.symbols[0]) << 16 | int(blue.symbols[0])
        return _copies(bits, green, far, total, width).astype("u4") << 8 | np.uint32(fixed)
    out, cache = [0] * total, [0] * (1 << cache_bits)
    at = kept = 0

    def remember(end: int) -> None:
        nonlocal kept
        if cache_bits:
            for v in out[kept:end]:
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        kept = end

    while at < total:
        group = codes[int(meta[(at // width >> block) * across + (at % width >> block)]) if meta is not None else 0]
        s = bits.symbol(group[0])
        if s < 256:
            red, blue, alpha = (bits.symbol(c) for c in group[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            n = _span(bits, s - 256)
            far = _distance(bits, group[4], width)
            if far > at or at + n > total:
                raise Damaged("a back-reference leaves the image")
            for k in range(at, at + n):
                out[k] = out[k - far]
            at += n
        else:
            remember(at)
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, "u4")


def _windows(bits: Bits, code: Code, size: int) -> tuple[np.ndarray, int]:
    """The code's next bits at every bit of so many bytes from where the reader is, and the first of these bytes."""
    first = bits.at >> 3
    data = np.frombuffer(bits._data, "u1")[first : first + size].astype("u4")
    data = np.concatenate([data, np.zeros(3, "u4")])
    wide = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    windows = np.empty((len(wide), 8), "u2")
    mask = (1 << code.bits) - 1
    for k in range(8):
        windows[:, k] = wide >> k & mask
    return windows.ravel(), first


def _literals(bits: Bits, code: Code, n: int) -> np.ndarray:
    """n symbols of one code in a row."""
    if not code.bits:
        return np.full(n, code.symbols[0], "u2")
    windows, first = _windows(bits, code, (n * code.bits >> 3) + 4)
    step = code.lengths[windows]
    place = np.arange(len(step), dtype="i4")
    clip = len(step) - 1
    two = step + step[np.minimum(place + step, clip)]
    jumps, at, seen = two.tobytes(), bits.at & 7, []
    add = seen.append
    try:
        for _ in range((n + 1) >> 1):
            add(at)
            at += jumps[at]
    except IndexError:
        raise Damaged("the image ends early") from None
    even = np.array(seen, "i4")
    both = np.empty((len(even), 2), "i4")
    both[:, 0], both[:, 1] = even, np.minimum(even + step[even], clip)
    at = both.ravel()[:n]
    end = int(at[-1]) + int(step[at[-1]]) + 8 * first
    if end > 8 * len(bits._data):
        raise Damaged("the image ends early")
    bits.at = end
    return code.symbols[windows[at]]


def _copies(bits: Bits, code: Code, far_code: Code, total: int, width: int) -> np.ndarray:
    """total samples of literals and back-references; literals are followed two at a time up to the next back-reference."""
    windows, first = _windows(bits, code, len(bits._data))
    symbol = code.symbols[windows]
    step = code.lengths[windows]
    clip = len(step) - 1
    one = np.where(symbol < 256, step, 0).astype("u1")  # 0: not a literal
    after = one[np.minimum(np.arange(len(step), dtype="i4") + step, clip)]
    two = np.where((one > 0) & (after > 0), one + after, 0).astype("u1").tobytes()
    out, done, at = np.empty(total, "u2"), 0, bits.at - 8 * first
    while done < total:
        seen: list[int] = []
        add = seen.append
        try:
            for _ in range((total - done) >> 1):
                if not (jump := two[at]):
                    break
                add(at)
                at += jump
            else:
                jump = 0
        except IndexError:
            raise Damaged("the image ends early") from None
        if seen:
            even = np.array(seen, "i4")
            out[done : done + 2 * len(seen) : 2] = symbol[even]
            out[done + 1 : done + 2 * len(seen) : 2] = symbol[even + step[even]]
            done += 2 * len(seen)
        if done == total:
            break
        if at > clip:
            raise Damaged("the image ends early")
        s, bits.at = int(symbol[at]), at + int(step[at]) + 8 * first
        if s < 256:
            out[done] = s
            done += 1
        elif s < 280:
            n = _span(bits, s - 256)
            far = _distance(bits, far_code, width)
            if far > done or done + n > total:
                raise Damaged("a back-reference leaves the image")
            out[done : done + n] = np.resize(out[done - far : done], n) if far < n else out[done - far : done - far + n]
            done += n
        else:
            raise Damaged("a symbol is out of range")
        at = bits.at - 8 * first
    bits.at = at + 8 * first
    if bits.at > 8 * len(bits._data):
        raise Damaged("the image ends early")
    return out


# --------------------------------------------------------------------------- inverse transforms


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> 24, argb >> 16 & 255, argb >> 8 & 255, argb & 255], -1).astype("i4")


def _unpredict(image: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width, _ = image.shape
    px = [[tuple(int(v) for v in p) for p in row] for row in image]

    def average(*ps):
        return tuple((a + b) >> 1 for a, b in zip(*ps, strict=True))

    def select(left, top, corner):
        near_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        near_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if near_left < near_top else top

    clamp = lambda v: max(0, min(255, v))

    def full(left, top, corner):
        return tuple(clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True))

    def half(left, top, corner):
        return tuple(clamp(m + int((m - c) / 2)) for m, c in zip(average(left, top), corner, strict=True))

    predict = {
        0: lambda left, t, tr, tl: (255, 0, 0, 0),
        1: lambda left, t, tr, tl: left,
        2: lambda left, t, tr, tl: t,
        3: lambda left, t, tr, tl: tr,
        4: lambda left, t, tr, tl: tl,
        5: lambda left, t, tr, tl: average(average(left, tr), t),
        6: lambda left, t, tr, tl: average(left, tl),
        7: lambda left, t, tr, tl: average(left, t),
        8: lambda left, t, tr, tl: average(tl, t),
        9: lambda left, t, tr, tl: average(t, tr),
        10: lambda left, t, tr, tl: average(average(left, tl), average(t, tr)),
        11: lambda left, t, tr, tl: select(left, t, tl),
        12: lambda left, t, tr, tl: full(left, t, tl),
        13: lambda left, t, tr, tl: half(left, t, tl),
    }
    for y in range(height):
        for x in range(width):
            if not y:
                guess = px[0][x - 1] if x else (255, 0, 0, 0)
            elif not x:
                guess = px[y - 1][0]
            else:
                above = px[y - 1]
                corner_right = above[x + 1] if x + 1 < width else px[y][0]
                mode = int(modes[y >> block, x >> block])
                guess = predict.get(mode, predict[0])(px[y][x - 1], above[x], corner_right, above[x - 1])
            px[y][x] = tuple((a + b) & 255 for a, b in zip(px[y][x], guess, strict=True))
    return np.array(px, "i4").reshape(image.shape)


def _uncross(image: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width, _ = image.shape
    each = factors[np.arange(height)[:, None] >> block, np.arange(width)[None] >> block]
    signed = lambda v: (v & 255 ^ 128) - 128
    delta = lambda f, c: signed(f) * signed(c) >> 5
    out = image.copy()
    out[..., 1] = image[..., 1] + delta(each[..., 3], image[..., 2]) & 255
    out[..., 3] = image[..., 3] + delta(each[..., 2], image[..., 2]) + delta(each[..., 1], out[..., 1]) & 255
    return out


def decode(data: bytes) -> np.ndarray:
    """Rows x columns x (alpha, red, green, blue), 8 bits each."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Damaged("no WebP file")
    at, body = 12, None
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            body = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if body is None or body[:1] != b"\x2f":
        raise Damaged("no lossless image")
    bits = Bits(body)
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Damaged("unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in undo]:
            raise Damaged("a transform occurs twice")
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            shape = -(-height >> block), -(-coded >> block)
            undo.append((kind, block, _channels(_pixels(bits, shape[1], shape[0], False)).reshape(*shape, 4)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = np.cumsum(_channels(_pixels(bits, n, 1, False)), axis=0) & 255
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, packed, colours))
            coded = -(-width >> packed)
        else:
            undo.append((kind, 0, None))
    argb = _pixels(bits, coded, height, True)
    image = _channels(argb).reshape(height, coded, 4)
    for kind, block, extra in reversed(undo):
        if kind == PREDICTOR:
            image = _unpredict(image, extra[..., 2], block)
        elif kind == CROSS:
            image = _uncross(image, extra, block)
        elif kind == SUBTRACT:
            image[..., 1] = image[..., 1] + image[..., 2] & 255
            image[..., 3] = image[..., 3] + image[..., 2] & 255
        else:
            index, each = image[..., 2], 8 >> block
            if block:
                index = (index[..., None] >> np.arange(1 << block) * each & (1 << each) - 1).reshape(height, -1)[:, :width]
            table = np.zeros((256, 4), "i4")
            table[: len(extra)] = extra
            image = table[index]
    return image.astype("u1")


# --------------------------------------------------------------------------- writing


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a best prefix code; counts are flattened until none is over 15."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), "i8")
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = n
            heapq.heapreplace(heap, (a[0] + b[0], n))
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(used)]) <= 15:
            out[used] = depth[: len(used)]
            return out
        weights = [(w + 3) >> 2 for w in weights]


class Writer:
    def __init__(self) -> None:
        self._value = self._n = 0

    def put(self, value: int, n: int) -> None:
        self._value |= value << self._n
        self._n += n

    def code(self, lengths: np.ndarray) -> None:
        """A code's lengths, by a fixed code for lengths with runs of zeros."""
        used = np.flatnonzero(lengths)
        if len(used) <= 2 and (not len(used) or used[-1] < 256):
            first = int(used[0]) if len(used) else 0
            self.put(1 | (len(used) == 2) << 1 | 1 << 2 | first << 3, 11)
            if len(used) == 2:
                self.put(int(used[1]), 8)
            return
        self.put(0, 1)
        self.put(15, 4)
        for k in LENGTH_ORDER:
            self.put(int(_OWN[k]), 3)
        self.put(0, 1)
        k, values = 0, lengths.tolist()
        while k < len(values):
            run = 0
            while k + run < len(values) and run < 138 and not values[k + run]:
                run += 1
            if run >= 3:
                s, extra, n = (18, run - 11, 7) if run >= 11 else (17, run - 3, 3)
                self.put(int(_OWN_CODES[s]), int(_OWN[s]))
                self.put(extra, n)
                k += run
            else:
                self.put(int(_OWN_CODES[values[k]]), int(_OWN[values[k]]))
                k += 1

    def bits(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Values of up to 32 bits each, all at once: every one falls on three neighbouring 16-bit words."""
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return
        at = ends - sizes
        wide = values.astype("u8") << (at & 15).astype("u8")
        word, n = at >> 4, int(ends[-1] >> 4) + 3
        words = sum(np.bincount(word + k, (wide >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype("f8"), n) for k in range(3))
        self._value |= int.from_bytes(words.astype("<u2").tobytes(), "little") << self._n
        self._n += int(ends[-1])

    def done(self) -> bytes:
        return self._value.to_bytes((self._n + 7) // 8, "little")


# A complete code over the 19 code-length symbols: five bits for rare lengths, four for the rest.
_OWN = np.full(19, 4)
_OWN[[1, 2, 13, 14, 15, 16]] = 5
_OWN_CODES = _mirrored(canonical(_OWN), _OWN)


def riff(body: bytes) -> bytes:
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def repeats(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeats to copy, in order and apart from each other; a run of LEAST + SPARSE * 8 samples that
    occurred before is found nearly always, whatever its place."""
    if len(data) < 2 * KEY:
        return []
    pair = data[:-1].astype("u8") | data[1:].astype("u8") << np.uint64(8)
    four = pair[:-2] | pair[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    key = (eight[: -(KEY - 8)] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[KEY - 8 :] * np.uint64(0xD6E8FEB86659FD93))
    key *= np.uint64(0xFF51AFD7ED558CCD)
    places = np.flatnonzero((key >> np.uint64(50)) % np.uint64(SPARSE) == 0)
    picked = key[places]
    order = np.argsort(picked, kind="stable")
    same = np.flatnonzero(picked[order[1:]] == picked[order[:-1]])
    out, done = [], 0
    for here, there in sorted(zip(places[order[same + 1]].tolist(), places[order[same]].tolist(), strict=True)):
        if here < done:
            continue
        far = here - there
        back = min(here - done, there, KEY * SPARSE)
        differ = np.flatnonzero(data[here - back : here] != data[there - back : there])
        start = here - back + (int(differ[-1]) + 1 if len(differ) else 0)
        end = here
        while end < len(data):
            part = data[end : end + MOST] != data[end - far : end - far + min(MOST, len(data) - end)]
            if part.any():
                end += int(part.argmax())
                break
            end += len(part)
        if end - start >= LEAST:
            out += [(at, min(MOST, end - at), far) for at in range(start, end, MOST)]
            done = end
    return out


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number, of lengths or distances from 1."""
    v = np.maximum(values - 1, 0)
    top = np.maximum(np.frexp(v.astype("f8"))[1] - 1, 0)
    second = v >> np.maximum(top - 1, 0) & 1
    symbol = np.where(v < 2, v, 2 * top + second)
    extra = np.where(v < 4, 0, top - 1)
    return symbol, v & (1 << extra) - 1, extra


def encode(samples: np.ndarray) -> bytes:
    """Rows x columns of 8-bit samples as a grey image."""
    height, width = samples.shape
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # no alpha, version 0
    w.put(1 | SUBTRACT << 1, 3)  # red and blue are stored as differences from green: 0
    w.put(0, 3)  # no further transform, no colour cache, one group of codes
    data = samples.ravel()
    found = repeats(data)
    if not found:
        green = code_lengths(np.bincount(data, minlength=ALPHABETS[0]))
        _heads(w, green, _only(0, ALPHABETS[4]))
        codes, sizes = _written(green)
        w.bits(codes[data], sizes[data])
        return riff(w.done())
    start, length, far = (np.array(x, "i8") for x in zip(*found, strict=True))
    alone = np.ones(len(data), bool)
    for at, n, _ in found:
        alone[at : at + n] = False
    literal = np.flatnonzero(alone)
    length_symbol, length_extra, length_bits = _prefixed(length)
    far_symbol, far_extra, far_bits = _prefixed(far + len(NEAR))  # smaller codes name near places
    green = code_lengths(np.bincount(data[literal], minlength=ALPHABETS[0]) + np.bincount(256 + length_symbol, minlength=ALPHABETS[0]))
    distance = code_lengths(np.bincount(far_symbol, minlength=ALPHABETS[4]))
    _heads(w, green, distance)
    (codes, sizes), (far_codes, far_sizes) = _written(green), _written(distance)
    # One list of values: a literal is one of them, a copy four; a stable sort by place puts them in order.
    value = [codes[data[literal]], codes[256 + length_symbol], length_extra, far_codes[far_symbol], far_extra]
    size = [sizes[data[literal]], sizes[256 + length_symbol], length_bits, far_sizes[far_symbol], far_bits]
    order = np.argsort(np.concatenate([literal, start, start, start, start]), kind="stable")
    w.bits(np.concatenate(value)[order], np.concatenate(size)[order])
    return riff(w.done())


def _only(symbol: int, size: int) -> np.ndarray:
    """A code of one symbol."""
    out = np.zeros(size, "i8")
    out[symbol] = 1
    return out


def _heads(w: Writer, green: np.ndarray, distance: np.ndarray) -> None:
    """The five codes of a grey image: red and blue 0, alpha 255."""
    for code in (green, _only(0, 256), _only(0, 256), _only(255, 256), distance):
        w.code(code)


def _written(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and number of bits of each symbol as they are written: a code of one symbol takes none."""
    if np.count_nonzero(lengths) < 2:
        return np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    return _mirrored(canonical(lengths), lengths), lengths


def store(payload: bytes) -> bytes:
    """A payload of a multiple of WIDTH bytes as images in a row."""
    rows = np.frombuffer(payload, "u1").reshape(-1, WIDTH)
    return b"".join(encode(rows[k : k + MAX_ROWS]) for k in range(0, len(rows), MAX_ROWS))


def load(media: bytes) -> np.ndarray:
    """Rows x WIDTH samples of stored images."""
    out, at = [], 0
    while at < len(media):
        size = struct.unpack_from("<I", media, at + 4)[0] + 8
        out.append(decode(media[at : at + size])[..., 2])
        at += size
    return np.concatenate(out)


# --------------------------------------------------------------------------- on DataFrames


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def feature(samples: np.ndarray) -> str:
    """Size, mean, entropy, and an 8 x 8 hash of the rows and columns that are over the mean."""
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts[counts > 0] / samples.size
    entropy, mean = float(-(p * np.log2(p)).sum()), float(counts @ np.arange(256)) / samples.size
    rows = np.linspace(0, len(samples), 9).astype(int)[:-1]
    sums = np.add.reduceat(samples.reshape(len(samples), 8, 8).sum(2, dtype="i8"), rows, axis=0)
    bits = np.packbits(sums > np.median(sums)).tobytes().hex()
    return f"{samples.shape[1]}x{samples.shape[0]};{mean:.4f};{entropy:.4f};{bits}"


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media binary."""
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [len(t.encode("utf-8", "surrogatepass")) for t in pdf["t"]]
            yield pd.DataFrame({"i": pdf["i"], "n": n, "media": [store(payload_of(t)) for t in pdf["t"]]})

    rows = docs.select(docs[id_col].alias("i"), text_of(docs, text_col).alias("t"))
    return rows.mapInPandas(write, f"i {kind}, n long, media binary").toDF(id_col, "n_bytes", "media")


def media_features(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored bytes back: id_col, n_bytes, the payload's and the media's sizes and digests, feature."""
    kind = media.schema[id_col].dataType.simpleString()

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, n, stored in zip(pdf["i"], pdf["n"], pdf["media"], strict=True):
                samples = load(stored)
                payload = samples.tobytes()
                digests = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()
                out.append((i, n, len(payload), *digests, feature(samples)))
            yield pd.DataFrame(out, columns=["i", "n", "pb", "ps", "tc", "mb", "ms", "f"])

    rows = media.select(media[id_col].alias("i"), media["n_bytes"].alias("n"), "media")
    read_back = rows.mapInPandas(read, f"i {kind}, n long, pb long, ps string, tc long, mb long, ms string, f string")
    return read_back.toDF(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
