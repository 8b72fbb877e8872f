"""Byte-level BPE with a minimal acyclic transducer as its lexicon.

``frequent_words`` counts space-separated words over all texts with mergeable bounded
summaries; ``build_lexicon`` compiles the commonest into a minimal acyclic automaton: equal
suffixes share their states, and the numbers on a path's arcs add up to the word's place in an
array of id lists. The image is a few MB at most (``lexicon_words`` bounds it), is broadcast,
written by each worker to an unlinked temporary file and memory-mapped. Words that it lacks are
merged exactly by rank. The lexicon saves merging and never changes an id.

A text may be cut before any space that follows a character other than white space, as no token
reaches over such a place; so words are looked up as whole pieces, each distinct one of a slice once, and
the ids of a slice are gathered from those of its words by array operations. Texts with a
space after white space, or with a special token's string, go piece by piece.

Defined results: null and empty texts have no ids; the special token's string in a text is its
id, as in the tokenizers library's default; repeated rows give repeated results; null ids pass
through; an empty table gives an empty result. Further columns of the input are left out.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import slices, text_of

#: Words kept by a partition's summary of counts, and pieces a worker remembers.
SUMMARY_WORDS = 100_000
REMEMBERED = 150_000
SLICE_BYTES = 3 << 20
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
# Fixed value: Unicode white space, as the tokenizers' patterns see it.
_WHITE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# --------------------------------------------------------------------------- vocabulary


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies spell printable bytes as themselves and the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens' bytes by id, merge ranks, and the exact merge of a piece of text."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.token_bytes = [b""] * (max([*self.ranks.values(), *special.values()]) + 1)
        for b, i in self.ranks.items():
            self.token_bytes[i] = b
        for t, i in special.items():
            self.token_bytes[i] = t.encode()
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self._merge = encoding.encode_ordinary
        self.merge_many = partial(encoding.encode_to_numpy, disallowed_special=())
        #: Merges bytes that are known to be one pre-token; the general merge looks for pre-tokens first.
        self.merge_one = getattr(encoding, "_encode_single_piece", None) or (lambda piece: self._merge(piece.decode()))
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def merge(self, piece: str) -> list[int]:
        return self._merge(piece)

    def parts(self, text: str) -> list[str]:
        """The text cut at special tokens' strings, which stand at the odd places."""
        return self._split.split(text) if self._split and any(s in text for s in self.special) else [text]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --------------------------------------------------------------------------- lexicon


def build_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The image of a minimal acyclic transducer from words to id lists.

    Words go in sorted; a state is frozen once no later word can extend it, and an equal frozen
    state is reused. Afterwards each arc gets the number of words that sort before it at its
    state, so that the sum along a path is the word's rank.
    """
    keys = sorted(words)
    frozen: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in frozen:
            frozen[key] = len(states)
            states.append(key)
        return frozen[key]

    path: list[list] = [[False, []]]  # open states: final, frozen arcs; the open arc is the last word's byte
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(final, arcs)))

    for key in keys:
        same = next((i for i, (x, y) in enumerate(zip(last, key, strict=False)) if x != y), min(len(last), len(key)))
        close(same)
        path += [[False, []] for _ in key[same:]]
        path[-1][0] = True
        last = key
    close(0)
    root = freeze(*path[0])
    below = [0] * len(states)  # targets are frozen before their sources
    for i, (final, arcs) in enumerate(states):
        below[i] = final + sum(below[t] for _, t in arcs)
    letters = bytes(sorted({b for k in keys for b in k}))
    place = {b: i + 1 for i, b in enumerate(letters)}  # 0: a byte of no word
    width = len(letters) + 1
    target, add = np.zeros((len(states) + 1, width), "u4"), np.zeros((len(states) + 1, width), "u4")
    for i, (is_final, arcs) in enumerate(states):  # state i is row i + 1; row 0 is the dead state
        before = int(is_final)
        for byte, to in arcs:
            target[i + 1, place[byte]], add[i + 1, place[byte]] = to + 1, before
            before += below[to]
    final = bytes([0, *(f for f, _ in states)])
    ids = array("I", [i for k in keys for i in words[k]])
    ends = np.cumsum([0, *(len(words[k]) for k in keys)]).astype("u4")
    classes = bytes(place.get(b, 0) for b in range(256))
    sections = [classes, final, target.tobytes(), add.tobytes(), ends.tobytes(), ids.tobytes()]
    sections = [x + b"\0" * (-len(x) % 4) for x in sections]
    return struct.pack(f"<{3 + len(sections)}I", root + 1, width, len(keys), *map(len, sections)) + b"".join(sections)


class Lexicon:
    """A memory-mapped transducer image."""

    def __init__(self, image: bytes) -> None:
        with tempfile.TemporaryFile() as f:  # has no name: it goes with the process
            f.write(image)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self._root, self._width, self.n_words, *sizes = struct.unpack_from("<9I", self._map)
        at = np.cumsum([36, *sizes])
        view = memoryview(self._map)
        part = [view[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self._classes, self._final = bytes(part[0]), bytes(part[1])
        self._target, self._add, self._ends, self._ids = (x.cast("I") for x in part[2:])
        self.n_states = len(self._target) // self._width - 1

    def get(self, word: bytes) -> list[int] | None:
        state, number, width = self._root, 0, self._width
        target, add = self._target, self._add
        for letter in word.translate(self._classes):
            arc = state * width + letter
            state = target[arc]
            if not state:
                return None
            number += add[arc]
        return self._ids[self._ends[number] : self._ends[number + 1]].tolist() if self._final[state] else None


# --------------------------------------------------------------------------- encoding


class _Pieces(dict):
    """Ids of `` `` + piece as bytes of unsigned 32-bit little-endian integers; bounded."""

    def __init__(self, encode, word) -> None:
        super().__init__()
        self._encode, self._word = encode, word
        self._mark = {m: encode(m) for m in ".,;:!?"}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        word, mark = (piece[:-1], self._mark[piece[-1]]) if piece[-1:] in self._mark else (piece, b"")
        if not word.isalpha() or max(word) >= "\u0250":
            found = self._encode(" " + piece)
        else:  # letters of long-known scripts are one pre-token with their space, and a mark is another
            found = self[word] + mark if mark else self._word((" " + word).encode())
        self[piece] = found
        return found


class Encoder:
    def __init__(self, path: str, image: bytes | None = None) -> None:
        self.vocabulary = vocabulary(path)
        self.lexicon = Lexicon(image) if image else None
        self._after_space = _Pieces(self._piece, self._word)
        self._seen: dict[str, bytes] = {}  # words of plain texts; those with a line break are without a space
        self._newline = self._piece("\n")
        self._lengths = np.array([len(b) for b in self.vocabulary.token_bytes], "i8")

    def _word(self, word: bytes) -> bytes:
        ids = self.lexicon.get(word) if self.lexicon else None
        return array("I", self.vocabulary.merge_one(word) if ids is None else ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.lexicon.get(piece.encode()) if self.lexicon else None
        return array("I", self.vocabulary.merge(piece) if ids is None else ids).tobytes()

    def _plain(self, text: str) -> bytes:
        first, *rest = _BEFORE_SPACE.split(text)
        return b"".join([self._piece(first), *[self._after_space[p[1:]] for p in rest]])

    def encode(self, text: str) -> bytes:
        parts = self.vocabulary.parts(text)
        special = self.vocabulary.special
        return b"".join(array("I", [special[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def _line_start(self, piece: str) -> bytes:
        return self._newline + self._piece(piece[1:])

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words of plain texts, each with the space before it or the line break that it begins with."""
        if self.lexicon is not None:
            return [self._one(w) for w in words]
        found = list(map(self._seen.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        plain = [k for k in new if words[k] and not words[k][-1].isspace()]
        merged = self._merged([words[k] if words[k][0] == "\n" else " " + words[k] for k in plain])
        if len(self._seen) + len(plain) > REMEMBERED:
            self._seen.clear()
        for k, ids in zip(plain, merged, strict=True):
            found[k] = self._seen[words[k]] = ids
        for k in new:
            if found[k] is None:
                found[k] = self._one(words[k])
        return found

    def _one(self, word: str) -> bytes:
        return self._line_start(word) if word[:1] == "\n" else self._after_space[word]

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin with a space or a line break and end with neither, so that no token reaches over their ends: merged at one go."""
        if not pieces:
            return []
        ids = self.vocabulary.merge_many("".join(pieces)).astype("<u4", copy=False)
        at = np.cumsum(self._lengths[ids])  # bytes up to each id's end
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), "i8", len(pieces)))
        stops = ((np.searchsorted(at, ends) + 1) * 4).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's ids end. No null among the texts."""
        odd = pc.match_substring_regex(texts, _WHITE + r"[ \n]|\n" + _WHITE)
        for s in self.vocabulary.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        # A line break that stands alone is a token of its own: it gets a cut before it, too.
        plain = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n")
        lists = pc.split_pattern(plain, " ")
        words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("i8"))
        starts = np.concatenate([np.zeros(1, "i8"), ends[:-1]]) if len(ends) else np.zeros(0, "i8")
        coded, firsts = words.dictionary_encode(), words.take(pa.array(starts)).dictionary_encode()
        place = coded.indices.to_numpy().astype("i8")
        place[starts] = firsts.indices.to_numpy() + len(coded.dictionary)  # no space before a text's first word
        ids = self._words(_strings(coded.dictionary))
        ids += [self._line_start(w) if w[:1] == "\n" else self._piece(w) for w in _strings(firsts.dictionary)]
        out, done = _gathered(ids, place)
        if not odd.any():
            return out, done[ends - 1]
        each = np.split(out, done[ends - 1][:-1]) if len(ends) else []
        parts, left = [], iter(each)
        for text, slow in zip(texts.to_pylist(), odd.tolist(), strict=True):
            parts.append(np.frombuffer(self.encode(text), "<u4") if slow else next(left))
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _gathered(values: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[i] for every i in place, end to end, as unsigned 32-bit numbers, and where each one ends."""
    flat = np.frombuffer(b"".join(values), "<u4")
    size = np.array([len(v) >> 2 for v in values], "i8")
    start = np.cumsum(size) - size
    n = size[place]
    ends = np.cumsum(n)
    at = np.repeat(start[place] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at], ends


def by_bytes(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes together, and at least one each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def frequent_words(docs: DataFrame, n: int, text_col: str = "text") -> list[str]:
    """The n commonest space-separated words over all texts.

    Each partition sends a summary of bounded size: whenever its table has twice
    SUMMARY_WORDS entries, the rarer half goes.
    """

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["t"]:
                seen.update(text.split(" ")[1:])
                if len(seen) > 2 * SUMMARY_WORDS:
                    seen = Counter(dict(heapq.nlargest(SUMMARY_WORDS, seen.items(), key=lambda x: x[1])))
        top = heapq.nlargest(n, seen.items(), key=lambda x: x[1])
        if top:
            yield pd.DataFrame(top, columns=["word", "n"])

    sums = docs.select(text_of(docs, text_col).alias("t")).mapInPandas(count, "word string, n long")
    sums = sums.filter(F.length("word") <= 64).groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in sums.orderBy(F.desc("n"), "word").limit(n).collect()]


def lexicon_image(docs: DataFrame, path: str, n: int, text_col: str = "text") -> bytes:
    vocab = vocabulary(path)
    words = {(" " + w).encode(): vocab.merge(" " + w) for w in frequent_words(docs, n, text_col)}
    return build_lexicon(words)


def bpe_encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 20_000) -> DataFrame:
    """id_col, ids binary (unsigned 32-bit little-endian ids), n_tokens long."""
    image = lexicon_image(docs, tokenizer_path, lexicon_words, text_col) if lexicon_words else None
    shared = docs.sparkSession.sparkContext.broadcast(image)
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, shared.value)
        for batch in batches:
            texts = batch.column("t")
            for a, b in by_bytes(texts):
                ids, ends = encoder.encode_all(texts[a:b])
                offsets = np.concatenate([np.zeros(1, "i8"), ends]) * 4
                binary = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("i")[a:b], binary, pa.array(np.diff(offsets) // 4)], names=["i", "ids", "n"])

    rows = docs.select(docs[id_col].alias("i"), text_of(docs, text_col).alias("t"))
    return rows.mapInArrow(encode, f"i {kind}, ids binary, n long").toDF(id_col, "ids", "n_tokens")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id") -> DataFrame:
    """Adds text, decoded from ids; special tokens become their strings."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = vocabulary(tokenizer_path).token_bytes.__getitem__
        for pdf in slices(batches):
            text = [b"".join(map(token, memoryview(x).cast("I"))).decode("utf-8", "replace") for x in pdf["ids"]]
            yield pdf.assign(text=text)

    return encoded.mapInPandas(decode, f"{kinds}, text string")
