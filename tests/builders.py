"""Small pictures and documents, made byte by byte."""

import io
import struct
import zipfile
import zlib

import numpy as np

from tesserae.functions import imaging as I
from tesserae.sources import hwp5


def noise(width=320, height=240, seed=1):
    rnd = np.random.RandomState(seed)
    return I.resize(rnd.randint(0, 256, (8, 8, 3)).astype("f8"), width, height).astype("u1")


def exif(model="", taken="", subsec="", uid="", orientation=0):
    """A little-endian TIFF structure with the given tags."""
    first, sub = [], []
    text = lambda tag, v, to: to.append((tag, 2, v.encode() + b"\0")) if v else None
    text(0x0110, model, first)
    text(0x9003, taken, sub)
    text(0x9291, subsec, sub)
    text(0xA420, uid, sub)
    if orientation:
        first.append((0x0112, 3, struct.pack("<H", orientation)))

    def directory(entries, at):
        data_at, head, data = at + 2 + 12 * len(entries) + 4, b"", b""
        for tag, kind, raw in sorted(entries):
            n = len(raw) // {2: 1, 3: 2, 4: 4}[kind]
            if len(raw) <= 4:
                value = raw.ljust(4, b"\0")
            else:
                value = struct.pack("<I", data_at + len(data))
                data += raw
            head += struct.pack("<HHI", tag, kind, n) + value
        return struct.pack("<H", len(entries)) + head + b"\0\0\0\0" + data

    probe = directory([*first, (0x8769, 4, b"\0\0\0\0")], 8)
    top = directory([*first, (0x8769, 4, struct.pack("<I", 8 + len(probe)))], 8)
    return b"II*\0" + struct.pack("<I", 8) + top + directory(sub, 8 + len(probe))


def png(rgb, tags=b""):
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    extra = chunk(b"eXIf", tags) if tags else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def shrunk(rgb, factor=2):
    return I.resize(rgb, rgb.shape[1] // factor, rgb.shape[0] // factor).astype("u1")


# --------------------------------------------------------------------------- binary documents


def record(tag, level, payload):
    n = len(payload)
    return struct.pack("<I", tag | level << 10 | min(n, 0xFFF) << 20) + (struct.pack("<I", n) if n >= 0xFFF else b"") + payload


def wide(text):
    return struct.pack("<H", len(text)) + text.encode("utf-16le")


def border_fill(image=0, solid=False, colours=0, image_first=False):
    kinds = (1 if solid else 0) | (2 if image else 0) | (4 if colours else 0)
    body = bytes(32) + struct.pack("<I", kinds) + (bytes(12) if solid else b"")
    gradient = struct.pack("<BIIIII", 1, 0, 50, 50, 50, colours) + bytes(4 * colours * (2 if colours > 2 else 1)) if colours else b""
    picture = struct.pack("<BbbBH", 5, 0, 0, 0, image) if image else b""
    return body + (picture + gradient if image_first else gradient + picture) + bytes(8)


def doc_info(bins, fills):
    out = b"".join(record(hwp5.BIN_DATA, 1, struct.pack("<HH", 1 | 2 << 4, i) + wide(ext)) for i, ext in bins)
    return out + b"".join(record(hwp5.BORDER_FILL, 1, f) for f in fills)


def cell_head(col, row, col_span=1, row_span=1, fill=1):
    return struct.pack("<II4HII4HH", 1, 0, col, row, col_span, row_span, 1000, 1000, 0, 0, 0, 0, fill) + bytes(12)


def control(kind, extra=bytes(20)):
    return kind.encode()[::-1] + extra


def picture(bin_id):
    return bytes(71) + struct.pack("<H", bin_id) + bytes(20)


def table(cells, level=1, inline=None):
    """cells: (col, row, col_span, row_span, fill, text); inline: picture number by cell index."""
    out = record(hwp5.PARA_HEADER, level - 1, bytes(24)) + record(hwp5.CTRL_HEADER, level, control("tbl ")) + record(hwp5.TABLE, level + 1, bytes(48))
    for k, (col, row, cs, rs, fill, text) in enumerate(cells):
        out += record(hwp5.LIST_HEADER, level + 1, cell_head(col, row, cs, rs, fill)) + record(hwp5.PARA_HEADER, level + 1, bytes(24))
        if text:
            out += record(hwp5.PARA_TEXT, level + 2, text.encode("utf-16le") + b"\r\0")
        if inline and k in inline:
            out += record(hwp5.PICTURE, level + 3, picture(inline[k]))
    return out


def compound(streams):
    """A compound file with every stream in ordinary sectors."""
    size = 512
    names = sorted({tuple(n.split("/")[:k]) for n in streams for k in range(1, n.count("/") + 2)})
    sectors, fat, where = [], [], {}

    def put(data):
        if not data:
            return hwp5.END
        first = len(sectors)
        for at in range(0, len(data), size):
            sectors.append(data[at : at + size].ljust(size, b"\0"))
            fat.append(len(sectors))
        fat[-1] = hwp5.END
        return first

    for n, data in streams.items():
        where[tuple(n.split("/"))] = put(data), len(data)
    ids = {p: k + 1 for k, p in enumerate(names)}
    children = lambda p: [q for q in names if q[:-1] == p]
    none = hwp5.FREE

    def entry(name, kind, right, child, start, n):
        raw = name.encode("utf-16le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, none, right, child) + bytes(36) + struct.pack("<IQ", start, n)

    top = children(())
    out = entry("Root Entry", 5, none, ids[top[0]], hwp5.END, 0)
    for p in names:
        row = children(p[:-1])
        k = row.index(p)
        right = ids[row[k + 1]] if k + 1 < len(row) else none
        inner = children(p)
        out += entry(p[-1], 2 if p in where else 1, right, ids[inner[0]] if inner else none, *where.get(p, (0, 0)))
    directory = put(out)
    n_fat = 1
    while (len(fat) + n_fat) * 4 > n_fat * size:
        n_fat += 1
    first_fat = len(sectors)
    fat += [0xFFFFFFFD] * n_fat
    raw = b"".join(struct.pack("<I", f) for f in fat).ljust(n_fat * size, b"\xff")
    places = [first_fat + k for k in range(n_fat)]
    head = hwp5.CFB_MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIIII", 0, n_fat, directory, 0, 0, hwp5.END, 0, hwp5.END, 0, 0)[:0]
    head += struct.pack("<I", 0) + struct.pack("<IIIIIIII", n_fat, directory, 0, 0, hwp5.END, 0, hwp5.END, 0)
    return head + struct.pack("<109I", *(places + [none] * 109)[:109]) + b"".join(sectors) + raw


def hwp(section, info, pictures, compressed=True, flags=0):
    """pictures: bytes by stream name, such as BIN0001.png."""
    pack = lambda d: zlib.compress(d)[2:-4] if compressed else d
    head = hwp5.SIGNATURE.ljust(32, b"\0") + struct.pack("<II", 0x05000300, int(compressed) | flags) + bytes(216)
    streams = {"FileHeader": head, "DocInfo": pack(info), "BodyText/Section0": pack(section)}
    return compound(streams | {f"BinData/{n}": d for n, d in pictures.items()})


# --------------------------------------------------------------------------- zipped documents


def hwpx(sections, items, fills=None, manifest=b"<manifest/>"):
    """sections: XML inside a section; items: (id, href, bytes); fills: picture id by fill id."""
    ns = 'xmlns:hp="http://example.org/p" xmlns:hc="http://example.org/c" xmlns:hh="http://example.org/h" xmlns:opf="http://example.org/opf"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/hwp+zip")
        z.writestr("META-INF/manifest.xml", manifest)
        listed = "".join(f'<opf:item id="{i}" href="{h}" media-type="image/png" isEmbeded="1"/>' for i, h, _ in items)
        z.writestr("Contents/content.hpf", f"<opf:package {ns}><opf:manifest>{listed}</opf:manifest></opf:package>")
        made = "".join(f'<hh:borderFill id="{k}"><hc:fillBrush><hc:imgBrush><hc:img binaryItemIDRef="{v}"/></hc:imgBrush></hc:fillBrush></hh:borderFill>' for k, v in (fills or {}).items())
        z.writestr("Contents/header.xml", f"<hh:head {ns}>{made}</hh:head>")
        for k, body in enumerate(sections):
            z.writestr(f"Contents/section{k}.xml", f"<hp:sec {ns}>{body}</hp:sec>")
        for _, h, d in items:
            z.writestr(h, d)
    return out.getvalue()


def tc(row, col, text="", fill="", pic="", note="", spans=(1, 1), inner=""):
    run = f"<hp:run><hp:t>{text}</hp:t></hp:run>" if text else ""
    image = f'<hp:run><hp:container><hp:pic><hp:shapeComment>{note}</hp:shapeComment><hc:img binaryItemIDRef="{pic}"/></hp:pic></hp:container></hp:run>' if pic else ""
    return (
        f'<hp:tc borderFillIDRef="{fill}"><hp:subList><hp:p>{run}{image}{inner}</hp:p></hp:subList><hp:cellAddr colAddr="{col}" rowAddr="{row}"/>'
        f'<hp:cellSpan colSpan="{spans[1]}" rowSpan="{spans[0]}"/></hp:tc>'
    )


def tbl(*cells):
    return "<hp:p><hp:run><hp:tbl>" + "".join(f"<hp:tr>{c}</hp:tr>" for c in cells) + "</hp:tbl></hp:run></hp:p>"
