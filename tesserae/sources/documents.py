"""Documents as tables: cells, pictures, fields, paragraphs and warnings, one pass over each file."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import captions as C
from tesserae.sources import files, hwp5, hwpx

HINT = "struct<original_name: string, width: int, height: int, taken_note: string>"
CELL = "struct<section: int, table_order: int, cell_no: int, depth: int, row: int, col: int, row_span: int, col_span: int, text: string, image_id: int, inline_ids: array<int>>"
ITEM = f"struct<bin_id: int, ext: string, data: binary, stream: string, kind: string, link: string, hint: {HINT}>"
FLOATING = "struct<section: int, para: int, nth: int, bin_id: int>"
PARAGRAPH = "struct<section: int, para: int, text: string>"
SCHEMA = f"doc string, format string, error string, encrypted boolean, warnings array<string>, cells array<{CELL}>, items array<{ITEM}>, floating array<{FLOATING}>, paragraphs array<{PARAGRAPH}>"


def parse(path: str, data: bytes, include_floating: bool) -> dict:
    """One document as a row of SCHEMA; a file that can't be read is a row with its error."""
    row = {"doc": path, "format": "", "error": None, "encrypted": False, "warnings": [], "cells": [], "items": [], "floating": [], "paragraphs": []}
    zipped = data[:4] == files.ZIP_START or data[:8] != files.OLE_START and path.lower().endswith(".hwpx")
    try:
        found = (hwpx if zipped else hwp5).read(data, include_floating)
    except hwp5.Encrypted as e:
        return row | {"error": str(e), "encrypted": True}
    except Exception as e:  # noqa: BLE001  one bad file is a row, not a failed job
        return row | {"error": f"읽는 중 문제가 생김: {e}"}
    items = {k: i for k, i in found.items.items() if hwp5.is_photo_like(i)}
    if dropped := len(found.items) - len(items):
        found.warnings.append(f"사진이라기에는 작은 그림 {dropped}개를 뺐습니다.")
    cells = []
    for n, c in enumerate(found.cells):
        image = found.images.get(c.fill)
        cells.append(
            {"section": c.section, "table_order": c.table_order, "cell_no": n, "depth": c.depth, "row": c.row, "col": c.col, "row_span": c.row_span, "col_span": c.col_span,
             "text": c.text, "image_id": image if image in items else None, "inline_ids": [b for b in c.pictures if b in items]}
        )
    stored = [{"bin_id": k, "ext": i.ext, "data": i.data, "stream": i.stream, "kind": i.kind, "link": i.link, "hint": found.hints.get(k)} for k, i in items.items()]
    floating = [{"section": s, "para": p, "nth": n, "bin_id": b} for n, (s, p, b) in enumerate(found.floating) if b in items]
    paragraphs = [{"section": s, "para": p, "text": t} for s, p, t in found.paragraphs]
    return row | {"format": found.format, "warnings": found.warnings, "cells": cells, "items": stored, "floating": floating, "paragraphs": paragraphs}


@dataclass
class Documents:
    """Views of parsed documents; ``parsed`` should be staged or cached, as every view reads it."""

    parsed: DataFrame

    def _exploded(self, column: str) -> DataFrame:
        return self.parsed.select("doc", F.explode(column).alias("x")).select("doc", "x.*")

    @property
    def docs(self) -> DataFrame:
        return self.parsed.select("doc", "format", "error", "encrypted", "warnings")

    @property
    def cells(self) -> DataFrame:
        return self._exploded("cells")

    @property
    def items(self) -> DataFrame:
        return self._exploded("items")

    def slots(self) -> DataFrame:
        floating = C.floating_captions(self._exploded("floating"), self._exploded("paragraphs"))
        return C.slots(C.resolve_captions(self.cells), floating)

    def fields(self) -> DataFrame:
        return C.extract_fields(self.cells)


def read_documents(found: DataFrame, include_floating: bool = False) -> DataFrame:
    """found: path, content. A row of SCHEMA per document."""

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):  # a document at a time: its pictures may be large
                yield pd.DataFrame([parse(path, bytes(content), include_floating)])

    return found.select("path", "content").mapInPandas(work, SCHEMA)
