"""Main text of web pages: what a page marks as its article, and host-wide repeats where marks leave it open.

A page is cut into blocks in one pass over its tags. Menus, headers, footers, sidebars, forms, hidden elements,
scripts and styles never count, nor do elements whose names say that they are nothing else (``ad``,
``cookie-notice``, ``comments-list``). A name that only contains such a word (``share-prices``) makes a block suspect. If the
page marks its article (``article``, else ``main``), the blocks inside are its text, and only suspect ones are open; on
a page without a mark all blocks are open.

Repeats are found by a host suffix array. The token streams of all the host's pages, marked or not, are laid end to end
and their suffixes ordered by their first ``RUN`` tokens; neighbours in that order which agree in them and come from distinct
pages are repeats (a longer one is a chain of them). They decide the open blocks: one that repeats cover to ``COVERED`` goes,
and the unique runs stay. A mark outweighs repeats: plain blocks inside one stay, and only count for other pages of the host.

The order is that of 64-bit hashes of the ``RUN`` tokens. A host of more than ``HOST_BYTES`` of html is cut into
ranges of the hash, so that none is gathered in a task; a task orders a range by the 48 bits below, and two prefixes are
taken for one with a chance of about 1e-8. A batch of pages sends a row for each range, with the pages' hashes packed. Only pages with open
blocks get their repeats back; the others are never shuffled. Pages are parsed twice, which takes less than keeping their texts.

A copied article repeats as boilerplate does, but on fewer pages than what surrounds it. So a repeat counts only if
more pages share it than share the rarest ``OWN`` of the page's tokens. Pages with equal streams count as one.

Defined results: null and empty html give an empty text; a null url is a host of its own; null
page_ids and repeated rows are carried through; extra columns are left out; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import slices, staged, text_of

RUN, COVERED, OWN = 6, 0.8, 0.1
HOST_BYTES = 1 << 25  # html of a host's pages that one range holds; about 4 million tokens
KEY_BYTES, MULTIPLIER = 6, 0x9E3779B97F4A7C1B

# Fixed values of HTML, and words by which pages name what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ITEMS = frozenset("li dt dd tr td th option".split())
OTHER = frozenset("nav footer aside form menu dialog button select option optgroup textarea fieldset datalist head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead "
    "footer cookie cookies consent notice notices popup modal newsletter subscribe share sharing social comment comments disqus related recommended login signup toolbar "
    "pagination".split()
)
FILLERS = frozenset("area bar block bottom box buttons container content inner item items left link links list main page right section site thread top widget wrap wrapper".split())
TOP = frozenset(("html", "body", "article", "main"))
OPEN, SUSPECT, OUT = range(3)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PARTS = re.compile(r"[a-z]+")


def _by_name(value: str) -> int:
    """OUT for names made of NAMES and FILLERS alone, SUSPECT for those with another word beside."""
    worst = OPEN
    for name in value.lower().split():
        parts = _PARTS.findall(name)
        if NAMES.intersection(parts):
            worst = max(worst, OUT if all(p in NAMES or p in FILLERS for p in parts) else SUSPECT)
    return worst


def _standing(tag: str, attrs: str, in_article: bool) -> int:
    if tag in OTHER or tag == "header" and not in_article:
        return OUT
    worst = OPEN
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and tag not in TOP:
            worst = max(worst, _by_name(value))
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return OUT
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return OUT
    return worst


class _Tags:
    """Finds one tag after another. Every character is passed a bounded number of times, whatever is left open."""

    def __init__(self, html: str) -> None:
        self._html = html
        self._last = {q: html.rfind(q) for q in "\"'>"}

    def _end(self, at: int) -> int:
        """The place after the tag that goes on at ``at``: its next > outside quotes, or the page's end."""
        start = at
        while (m := _STOP.search(self._html, at)) is not None:
            if m[0] == ">":
                return m.end()
            if m.start() == self._last[m[0]]:  # a quote that nothing closes
                break
            at = self._html.find(m[0], m.end()) + 1
        over = self._html.find(">", max(start, at)) if self._last[">"] >= at else -1
        return over + 1 if over >= 0 else len(self._html)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Begin, end, whether it closes, name and attributes; the name is empty for comments and declarations."""
        html = self._html
        while (begin := html.find("<", at)) >= 0:
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                return begin, end + 3 if end >= 0 else len(html), False, "", ""
            if html[begin + 1 : begin + 2] in ("!", "?"):
                end = html.find(">", begin) if self._last[">"] > begin else -1
                return begin, end + 1 if end >= 0 else len(html), False, "", ""
            closing = html[begin + 1 : begin + 2] == "/"
            m = _NAME.match(html, begin + 1 + closing)
            if m:
                end = self._end(m.end())
                return begin, end, closing, m[0].lower(), html[m.end() : end].removesuffix(">")
            at = begin + 1
        return None


class _Open:
    """Open elements. Each knows where the last one of every name and the last block is, so nothing is searched."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, bool, bool, int]] = [("", OPEN, False, False, 0)]  # tag, standing, in article, in main, last block
        self._places: dict[str, list[int]] = {}

    @property
    def top(self) -> tuple[str, int, bool, bool, int]:
        return self.rows[-1]

    def push(self, tag: str, standing: int, in_article: bool, in_main: bool) -> None:
        at = len(self.rows)
        self.rows.append((tag, standing, in_article, in_main, self.top[4] if tag in INLINE else at))
        self._places.setdefault(tag, []).append(at)

    def last(self, tag: str) -> int:
        places = self._places.get(tag)
        return places[-1] if places else 0

    def cut(self, at: int) -> None:
        while len(self.rows) > at:
            self._places[self.rows.pop()[0]].pop()


def page_blocks(html: str) -> tuple[bool, list[tuple[str, bool]]]:
    """Whether the page marks its article, and the blocks of its text in page order, each with whether it is suspect."""
    found: list[tuple[str, bool, bool, bool]] = []  # text, suspect, in article, in main
    marked = {"article": False, "main": False}
    tags, opened = _Tags(html), _Open()
    held: list[str] = []
    place = opened.top  # where what is held began: elements that are left out may have opened inside it

    def hold(text: str) -> None:
        nonlocal place
        if not held:
            place = opened.top
        if opened.top[1] != OUT:  # what is left out is never held
            held.append(text)

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            found.append((text, place[1] == SUSPECT, place[2], place[3]))

    at = 0
    while at < len(html):
        tag = tags.next(at)
        upto = tag[0] if tag else len(html)
        if upto > at:
            hold(html[at:upto])
        if not tag:
            break
        _, at, closing, name, attrs = tag
        if name in ("br", "hr"):
            hold(" ") if name == "br" else flush()
        if not name or name in VOID:
            continue
        inline = name in INLINE
        if closing:
            begun = opened.last(name)
            if not begun:
                flush() if not inline else None
                continue
            if not inline:
                flush()
            if not inline or opened.top[4] < begun:  # an inline element with an open block inside stays open
                opened.cut(begun)
            continue
        if name in RAW:
            flush()
            if not attrs.rstrip().endswith("/"):
                close = re.compile(f"</{re.escape(name)}[\\s>/]|</{re.escape(name)}$", re.I).search(html, at)
                over = html.find(">", close.start()) if close else -1
                at = over + 1 if over >= 0 else len(html)
            continue
        if not inline:
            flush()
            block = opened.top[4]
            if opened.rows[block][0] == "p" or opened.rows[block][0] == name and name in ITEMS:  # a block ends an open paragraph, an item an open item
                opened.cut(block)
        _, standing, in_article, in_main, _ = opened.top
        standing = max(standing, _standing(name, attrs, in_article)) if standing != OUT else OUT
        if standing != OUT and name == "article":
            in_article, marked["article"] = True, True
        if standing != OUT and (name == "main" or re.search(r"role\s*=\s*[\"']?main\b", attrs)):
            in_main, marked["main"] = True, True
        if not attrs.endswith("/"):
            opened.push(name, standing, in_article, in_main)
    flush()
    for mark, inside in (("article", 2), ("main", 3)):
        own = [(b[0], b[1]) for b in found if b[inside]]
        if marked[mark] and own:
            return True, own
    return False, [(b[0], b[1]) for b in found]


def blocks(html: str) -> tuple[bool, list[str]]:
    """Whether the page marks its article, and the blocks of its text in page order."""
    marked, parts = page_blocks(html)
    return marked, [text for text, _ in parts]


def host_of(url: str) -> str:
    return url.partition("://")[2].partition("/")[0].partition("?")[0].rpartition("@")[2].lower()


def _digest(parts: list[str]) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest("\n".join(parts))).view("i8"))


def _prefixes(streams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first RUN tokens of all suffixes that are so long, and how many each stream has. One space between tokens."""
    lists = pc.split_pattern(pa.array(streams, pa.string()), " ")
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
    coded = lists.flatten().dictionary_encode()
    token = np.array([xxhash.xxh3_64_intdigest(t) for t in coded.dictionary.to_pylist()], "u8")[coded.indices.to_numpy(zero_copy_only=False)]
    per = np.maximum(n - RUN + 1, 0)
    at = np.arange(int(per.sum())) + np.repeat(np.cumsum(n) - n - (np.cumsum(per) - per), per)
    x = np.zeros(len(at), "u8")
    for k in range(RUN):
        x = x * np.uint64(MULTIPLIER) + token[at + k]
    x = (x ^ x >> np.uint64(31)) * np.uint64(MULTIPLIER)  # the multiplier mixes upwards only
    return x ^ x >> np.uint64(29), per


def _stream(parts: list[str]) -> tuple[list[int], int]:
    """Prefix hash of each suffix of RUN tokens or more, and the stream's hash."""
    return _prefixes([" ".join(parts)])[0].view("i8").tolist(), _digest(parts)


def _digest(parts: list[str]) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest("\n".join(parts))).view("i8"))


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view("u1").reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpacked(keys: bytes) -> np.ndarray:
    out = np.zeros((len(keys) // KEY_BYTES, 8), "u1")
    out[:, :KEY_BYTES] = np.frombuffer(keys, "u1").reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u8")


def _in_bytes(pages: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a byte each: a page with more than 255 comes several times."""
    times = -(-n // 255)
    out = np.full(int(times.sum()), 255, "u1")
    out[np.cumsum(times) - 1] = n - 255 * (times - 1)
    return np.repeat(pages, times), out


def suffix_order(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their prefixes and pages, once for each page, and how many pages have each one's prefix."""
    order = np.lexsort((owner, keys))
    key, page = keys[order], owner[order]
    begins = np.ones(len(order), bool)
    begins[1:] = key[1:] != key[:-1]
    fresh = begins.copy()
    fresh[1:] |= page[1:] != page[:-1]
    group = np.cumsum(begins) - 1
    return order[fresh], np.bincount(group, fresh).astype("i8")[group[fresh]]


def keep_unique(parts: list[str], repeated: Iterable[int], may_go: list[bool] | None = None) -> list[str]:
    """Blocks that runs starting at the repeated suffixes don't cover, and those that may not go; all, if none is left."""
    n = [len(p.split()) for p in parts]
    covered = np.zeros(sum(n), bool)
    for i in repeated:
        covered[i : i + RUN] = True
    ends = np.cumsum([0, *n])
    left = [p for k, p in enumerate(parts) if may_go is not None and not may_go[k] or n[k] == 0 or covered[ends[k] : ends[k + 1]].mean() < COVERED]
    return left or parts


def boilerplate(n_tokens: int, shared: dict[int, int]) -> list[int]:
    """Suffixes that more pages share than share the page's rarest tokens. shared: how many pages, by suffix, where several do."""
    pages = np.ones(n_tokens, "i8")
    for i, k in shared.items():
        pages[i : i + RUN] = np.maximum(pages[i : i + RUN], k)
    own = np.sort(pages)[int(OWN * n_tokens)] if n_tokens else 1
    return [i for i, k in shared.items() if k > own]


def _settled(parts: list[str], may_go: list[bool], found: list | None) -> str:
    """The page's text. found: keys that several pages have, and how many have them, by range."""
    if not found:
        return " ".join(parts)
    pages = {k: n for f in found for k, n in zip(_unpacked(f["keys"]).tolist(), np.frombuffer(f["pages"], "<u4").tolist(), strict=True)}
    keys = _unpacked(_packed(_prefixes([" ".join(parts)])[0])).tolist()
    shared = {i: pages[k] for i, k in enumerate(keys) if k in pages}
    return " ".join(keep_unique(parts, boilerplate(sum(len(p.split()) for p in parts), shared), may_go))


def _ranges(pages: DataFrame) -> dict[str, int]:
    """Ranges of hosts that have several: no more hosts than the corpus has times HOST_BYTES."""

    def sizes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(host=[host_of(u) for u in pdf["url"]]).groupby("host", as_index=False)["n"].sum()

    rows = pages.filter("url is not null and html is not null").select("url", F.octet_length("html").cast("long").alias("n"))
    found = rows.mapInPandas(sizes, "host string, n long").groupBy("host").agg(F.sum("n").alias("n")).filter(F.col("n") > HOST_BYTES)
    return {r.host: min(-(-r.n // HOST_BYTES), 1 << 16) for r in found.collect()}


def _repeats(pages: DataFrame) -> DataFrame:
    """Keys that several pages of a host have, and how many have them, for streams (host, own) with open blocks. pages: url, h."""
    ranges = pages.sparkSession.sparkContext.broadcast(_ranges(pages.withColumnRenamed("h", "html")))

    def suffixes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, 1000):
            streams: dict[tuple[str, int], tuple[str, bool]] = {}
            for url, html in zip(pdf["url"], pdf["h"], strict=True):
                marked, found = page_blocks(html)
                parts = [t for t, _ in found]
                if parts:
                    key = host_of(url), _digest(parts)
                    is_open = not marked or any(suspect for _, suspect in found)
                    streams[key] = " ".join(parts), is_open or key in streams and streams[key][1]
            if not streams:
                continue
            keys, per = _prefixes([text for text, _ in streams.values()])
            hosts, host = np.unique(np.array([h for h, _ in streams], object), return_inverse=True)
            own, is_open = np.array([o for _, o in streams], "i8"), np.array([o for _, o in streams.values()])
            page = np.repeat(np.arange(len(per)), per)
            dealt = np.array([ranges.value.get(h, 1) for h in hosts], "u8")
            part = (keys >> np.uint64(48)) * dealt[host[page]] >> np.uint64(16)
            target = host[page] << 16 | part.astype("i8")
            order = np.argsort(target, kind="stable")  # pages stay in order
            target, page = target[order], page[order]
            out = []
            for at in np.split(np.arange(len(order)), np.flatnonzero(np.diff(target)) + 1) if len(order) else []:
                p, n = _in_bytes(*np.unique(page[at], return_counts=True))
                out.append((hosts[target[at[0]] >> 16], int(target[at[0]] & 0xFFFF), own[p].astype("<i8").tobytes(), is_open[p].tobytes(), n.tobytes(), _packed(keys[order[at]])))
            yield pd.DataFrame(out, columns=["host", "part", "own", "open", "n", "keys"])

    def ordered(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for pdf in batches:
            for host, part, *row in zip(*(pdf[c] for c in ("host", "part", "own", "open", "n", "keys")), strict=True):
                if held and (host, part) != last:
                    yield _shared(last[0], held)
                    held = []
                held.append(row)
                last = host, part
        if held:
            yield _shared(last[0], held)

    rows = pages.filter("url is not null").mapInPandas(suffixes, "host string, part int, own binary, open binary, n binary, keys binary")
    dealt = rows.repartition("host", "part").sortWithinPartitions("host", "part")
    return staged(dealt.mapInPandas(ordered, "host string, own long, keys binary, pages binary"), "repeats")


def _shared(host: str, rows: list[list[bytes]]) -> pd.DataFrame:
    """What several pages have in one range of a host's suffix array, by page with open blocks."""
    own, is_open, n, keys = (b"".join(x) for x in zip(*rows, strict=True))
    owns, page = np.unique(np.frombuffer(own, "<i8"), return_inverse=True)
    asks = np.zeros(len(owns), bool)
    asks[page[np.frombuffer(is_open, "?")]] = True
    keys, owner = _unpacked(keys), np.repeat(page, np.frombuffer(n, "u1"))
    order, pages = suffix_order(keys, owner)
    back = (pages > 1) & asks[owner[order]]
    order, pages = order[back], pages[back]
    by_page = np.argsort(owner[order], kind="stable")
    order, pages = order[by_page], pages[by_page]
    cuts = np.split(np.arange(len(order)), np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else []
    found = [(host, int(owns[owner[order[c[0]]]]), _packed(keys[order[c]]), pages[c].astype("<u4").tobytes()) for c in cuts]
    return pd.DataFrame(found, columns=["host", "own", "keys", "pages"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", text_of(pages, "html").alias("h"))
    repeats = _repeats(rows.select("url", "h"))
    none = repeats.isEmpty()  # no open block has a repeat: every one stays

    def parsed(are_open: bool, shape: str) -> DataFrame:
        """Pages that wait for repeats, or all others with their text."""

        def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["h"], strict=True):
                    marked, found = page_blocks(html)
                    parts, may_go = [t for t, _ in found], [suspect or not marked for _, suspect in found]
                    if (not none and url is not None and any(may_go)) == are_open:
                        out.append((page_id, url, host_of(url), _digest(parts), parts, may_go) if are_open else (page_id, url, " ".join(parts)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in shape.split(", ")]).astype({"page_id": object})

        return rows.mapInPandas(parse, shape)

    result = f"page_id {kind}, url string, text string"
    settled = parsed(False, result)
    if none:
        return settled

    def keep(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = (pdf[c] for c in ("parts", "may_go", "found"))
            yield pdf[["page_id", "url"]].assign(text=[_settled(list(parts), list(may_go), found if found is None else list(found)) for parts, may_go, found in zip(*columns, strict=True)])

    found = repeats.groupBy("host", "own").agg(F.collect_list(F.struct("keys", "pages")).alias("found"))
    waiting = parsed(True, f"page_id {kind}, url string, host string, own long, parts array<string>, may_go array<boolean>")
    return settled.unionByName(waiting.join(found, ["host", "own"], "left").select("page_id", "url", "parts", "may_go", "found").mapInPandas(keep, result))
