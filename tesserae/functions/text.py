"""Text expressions: names, captions, digits, paths. Only Unicode composition needs Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Fixed values of captions and file names.
MAX_CAPTION = 40
MAX_FIELD_VALUE = 200
MAX_NAME_BYTES = 150
SYMBOLS_ONLY = r"^[\s\-–—·ㆍ.,:;/\\()\[\]{}<>~=_]*$"
NUMBERS_ONLY = r"^[\s0-9①-⑳.,\-–—/()\[\]=~·]*$"
LEADING_NUMBER = (
    r"^\s*[<\[(【〈]?\s*(?:사진|그림|도면)\s*[0-9①-⑳]+\s*[.)\]>》】]?[\s:·]+"
    r"|^\s*[<\[(【〈]\s*[0-9①-⑳]+\s*[)\]>》】]\s*"
    r"|^\s*[0-9]+\s*[.)\]>》】]\s*"
    r"|^\s*[①-⑳]+\s*[.)\]>》】]?\s*"
)
CLIPBOARD_NAME = r"(?i)^(CLP[0-9a-f]{8,}|image\d*|clip(board)?_?\d*|무제|untitled)$"
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{k}{i}" for k in ("COM", "LPT") for i in range(1, 10)))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def collapse(text: Column) -> Column:
    """Runs of white space, ideographic too, as one space; trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s　]+", " "))


def normalize(text: Column) -> Column:
    return collapse(nfc(F.coalesce(text, F.lit(""))))


def clean_caption(text: Column, strip_numbering: bool = False) -> Column:
    """A caption without its leading number, which needs a mark or a space after it."""
    flat = normalize(text)
    return F.trim(F.regexp_replace(flat, LEADING_NUMBER, "")) if strip_numbering else flat


def is_caption_like(flat: Column) -> Column:
    """Of normalised text: not empty, short enough, more than symbols or numbers."""
    return (flat != "") & (F.length(flat) <= MAX_CAPTION) & ~flat.rlike(SYMBOLS_ONLY) & ~flat.rlike(NUMBERS_ONLY)


def loose(text: Column) -> Column:
    """For comparing names: lower case, no white space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")


def digit_signature(text: Column) -> Column:
    """The numbers in a name, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+)"), F.lit(1))
    return F.transform(found, lambda d: d.cast("decimal(38,0)").cast("long"))


def digits_agree(folder: Column, document: Column) -> Column:
    """Both without numbers, or the folder's numbers are among the document's."""
    inside = F.size(F.array_except(folder, document)) == 0
    return (F.size(folder) == 0) & (F.size(document) == 0) | (F.size(folder) > 0) & (F.size(document) > 0) & inside


def clean_path(text: Column) -> Column:
    """A path as typed or dropped: without spaces around, a pair of quotes, and slashes at the end."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    inner = F.trim(F.regexp_replace(bare, r"""^(["'])(.*)\1$""", "$2"))
    cut = F.regexp_replace(inner, r"[\\/]+$", "")
    return F.when(cut == "", inner).otherwise(cut)


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading point is no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    """The last suffix with its point, or empty."""
    return F.regexp_extract(base_name(name), r"^.+(\.[^.]+)$", 1)


def name_key(path: Column) -> Column:
    """For equality of file names: base name, composed, lower case."""
    return F.lower(nfc(base_name(path)))


def useful_name(name: Column) -> Column:
    """The name, or null for those that a clipboard makes up."""
    return F.when((name != "") & ~stem(base_name(name)).rlike(CLIPBOARD_NAME), name)


def lowres_suffix(ext: Column) -> Column:
    """Suffix of an embedded picture: lower case, .jpeg as .jpg, .jpg if unknown."""
    bare = F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), r"^\.+", "")
    return F.when(bare.isin("", "jpeg"), ".jpg").otherwise(F.concat(F.lit("."), bare))


def original_suffix(path: Column) -> Column:
    found = suffix(path)
    return F.when(found == "", ".jpg").otherwise(found)


def safe_name(name: str | None, fallback: str = "이름없음") -> str:
    """A part of a file name that every system takes."""
    text = "".join(c for c in name or "" if not 0xD800 <= ord(c) <= 0xDFFF)
    text = re.sub(r"[\n\t]", " ", unicodedata.normalize("NFC", text))
    text = re.sub(r"\s+", " ", re.sub(r'[<>:"/\\|?*\x00-\x1f]', "", text)).strip().rstrip(". ")
    if not text:
        return fallback
    if text.upper().split(".")[0] in RESERVED:
        text = "_" + text
    raw = text.encode()
    return (raw[:MAX_NAME_BYTES].decode("utf-8", "ignore").rstrip() if len(raw) > MAX_NAME_BYTES else text) or fallback


def sanitize(name: Column, fallback: str = "이름없음") -> Column:
    @F.pandas_udf("string")
    def safe(names: pd.Series) -> pd.Series:
        return names.map(lambda n: safe_name(n, fallback))

    return safe(name)


def fill_template(template: str, values: dict[str, str]) -> str:
    """Names in braces replaced by their values, unknown ones by nothing; doubled separators become one."""
    filled = re.sub(r"\{([^{}]+)\}", lambda m: safe_name(values.get(m[1].strip(), ""), ""), template)
    return safe_name(re.sub(r"([ _\-])[ _\-]+", r"\1", filled).strip(" _-"))


def apply_template(template: str, variables: Column) -> Column:
    """variables: map of strings."""

    @F.pandas_udf("string")
    def fill(maps: pd.Series) -> pd.Series:
        return maps.map(lambda m: fill_template(template, dict(m or {})))

    return fill(variables)


@F.pandas_udf(DoubleType())
def name_ratio(names: pd.Series, wanted: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of a name to the one that is looked for."""
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, n, w).ratio() for n, w in zip(names, wanted, strict=True)], dtype="f8")


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, with one digit; of two equally near digits the even one."""

    def unit(k: int) -> Column:
        rest = n.bitwiseAND(F.lit((1 << k) - 1)) * 10  # a tenth is 1 << k of it
        tenths, over = F.shiftright(n, k) * 10 + F.shiftright(rest, k), rest.bitwiseAND(F.lit((1 << k) - 1))
        up = (over > 1 << k - 1) | (over == 1 << k - 1) & (tenths % 2 == 1)
        tenths = tenths + up.cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))

    n = n.cast("long")
    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit("B")))
        .when(n < 1 << 20, F.concat(unit(10), F.lit("KB")))
        .when(n < 1 << 30, F.concat(unit(20), F.lit("MB")))
        .otherwise(F.concat(unit(30), F.lit("GB")))
    )


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out
