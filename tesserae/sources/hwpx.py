"""The zipped XML document format. Element names are compared without their namespaces, which vary."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from tesserae.sources.hwp5 import Cell, Document, Encrypted, Item, Unreadable, hint_of

# Parts of the archive, and marks inside text.
CONTENT, HEADER, MANIFEST = "contents/content.hpf", "contents/header.xml", "meta-inf/manifest.xml"
MARKS = {"tab": "\t", "lineBreak": "\n", "columnBreak": "\n", "nbSpace": " ", "fwSpace": " ", "hypen": "­", "hyphen": "­", "softHyphen": "­"}
Node = ElementTree.Element


def _name(node: Node) -> str:
    return node.tag.rpartition("}")[2]


def _all(node: Node, name: str) -> Iterator[Node]:
    return (n for n in node.iter() if _name(n) == name)


def _child(node: Node, name: str) -> Node | None:
    return next((n for n in node if _name(n) == name), None)


def _whole(node: Node | None, key: str, default: int = 0) -> int:
    try:
        return int((node.get(key) or "").strip()) if node is not None else default
    except ValueError:
        return default


def _below(node: Node, enter: Callable[[str], bool]) -> Iterator[Node]:
    """Descendants in order; enter(name) tells whether to go on inside. Nested tables are never entered."""
    for n in node:
        if _name(n) == "tbl":
            continue
        yield n
        if enter(_name(n)):
            yield from _below(n, enter)


def _run(node: Node) -> str:
    parts = [node.text or ""]
    for n in node:
        parts += [MARKS.get(_name(n), ""), n.text or "", n.tail or ""]
    return "".join(parts)


def cell_text(cell: Node) -> str:
    """Paragraphs of a cell's own list, by lines."""
    own = _child(cell, "subList")
    lines = []
    for p in [] if own is None else own:
        if _name(p) == "p":
            inside = _below(p, lambda name: name not in ("t", "linesegarray", "pic", "shapeComment"))
            parts = [_run(n) if _name(n) == "t" else MARKS.get(_name(n), "") if _name(n) in ("tab", "lineBreak", "columnBreak") else "" for n in inside]
            lines.append("".join(parts).strip())
    return "\n".join(x for x in lines if x)


def cell_pictures(cell: Node) -> list[tuple[str, str]]:
    """References and descriptions of a cell's pictures, those in containers too."""
    own = _child(cell, "subList")
    out = []
    for pic in [] if own is None else _below(own, lambda name: name != "pic"):
        if _name(pic) != "pic":
            continue
        image, note = next(_all(pic, "img"), None), next(_all(pic, "shapeComment"), None)
        if image is not None and image.get("binaryItemIDRef"):
            out.append((image.get("binaryItemIDRef"), "".join(note.itertext()).strip() if note is not None else ""))
    return out


def own_cells(table: Node) -> list[Node]:
    return [n for n in _below(table, lambda name: name != "tc") if _name(n) == "tc"]


def read(data: bytes, include_floating: bool = False) -> Document:
    """Pictures and fills are numbered by their first use. Pictures outside tables are read if asked for."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError) as e:
        raise Unreadable(f"묶음 파일이 열리지 않습니다 ({e})") from e
    names = {n.lower(): n for n in archive.namelist()}
    part = lambda name: archive.read(names[name.lower()]) if name.lower() in names else None
    if b"encryption-data" in (part(MANIFEST) or b""):
        raise Encrypted("암호로 잠긴 문서입니다.")
    try:
        listed = {n.get("id"): n for n in _all(ElementTree.fromstring(part(CONTENT) or b""), "item") if n.get("id")}
    except ElementTree.ParseError as e:
        raise Unreadable(f"문서의 내용 목록이 깨져 있습니다 ({e})") from e
    fills: dict[str, str] = {}
    try:
        for fill in _all(ElementTree.fromstring(part(HEADER) or b"<none/>"), "borderFill"):
            image = next((i for b in _all(fill, "imgBrush") for i in _all(b, "img") if i.get("binaryItemIDRef")), None)
            if fill.get("id") and image is not None:
                fills[fill.get("id")] = image.get("binaryItemIDRef")
    except ElementTree.ParseError:
        pass
    out = Document("hwpx")
    numbers: dict[str, int] = {}
    fill_numbers: dict[str, int] = {}
    number = lambda table, key: table.setdefault(key, len(table) + 1)
    sections = [n for n in names.values() if re.fullmatch(r"contents/section.*\.xml", n.lower())]
    order = 0
    for k, name in enumerate(sorted(sections, key=lambda n: int("0" + re.sub(r"\D", "", n.rpartition("/")[2])))):
        try:
            root = ElementTree.fromstring(archive.read(name))
        except ElementTree.ParseError as e:
            out.warnings.append(f"{name}: 읽을 수 없는 구역 ({e})")
            continue
        depth = {}
        for table in _all(root, "tbl"):
            order += 1
            inside = depth.get(table, 0)
            for nested in _all(table, "tbl"):
                if nested is not table:
                    depth[nested] = inside + 1
            for tc in own_cells(table):
                at, span, fill = _child(tc, "cellAddr"), _child(tc, "cellSpan"), tc.get("borderFillIDRef") or ""
                rows, cols = (max(1, _whole(span, s, 1)) for s in ("rowSpan", "colSpan"))
                cell = Cell(k, order, inside, _whole(at, "rowAddr"), _whole(at, "colAddr"), rows, cols, number(fill_numbers, fill) if fill else 0, cell_text(tc))
                if fill in fills:
                    out.images[cell.fill] = number(numbers, fills[fill])
                for ref, note in cell_pictures(tc):
                    cell.pictures.append(number(numbers, ref))
                    if hint := hint_of(note):
                        out.hints.setdefault(numbers[ref], hint)
                out.cells.append(cell)
        if include_floating:
            for n, p in enumerate((p for p in root if _name(p) == "p"), 1):
                wrapped = ElementTree.Element("tc")
                holder = ElementTree.SubElement(wrapped, "subList")
                holder.append(p)
                if text := cell_text(wrapped):
                    out.paragraphs.append((k, n, text))
                out.floating += [(k, n, number(numbers, ref)) for ref, _ in cell_pictures(wrapped)]
    for ref, bin_id in numbers.items():
        if ref not in listed:
            out.warnings.append(f"{ref} 그림은 내용 목록에 없습니다.")
            continue
        href = listed[ref].get("href", "")
        ext = href.rpartition(".")[2].lower() if "." in href.rpartition("/")[2] else ""
        stored = None if listed[ref].get("isEmbeded", "1") == "0" else part(href)
        out.items[bin_id] = Item(bin_id, ext, b"", href, "link", href) if stored is None else Item(bin_id, ext, stored, href)
    return out
