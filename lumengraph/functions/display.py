"""Text measures, markup helpers and the wiring codec: small scalar kernels and their Spark forms."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate, chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructType

# Ranges that take no room and double room, and the advance of one unit.
NO_ROOM = ((0x0300, 0x036F), (0x064B, 0x065F), (0x200B, 0x200F))
DOUBLE = ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1FAFF))
ADVANCE = 0.6


def _unit(c: str) -> int:
    u = ord(c)
    return 0 if any(a <= u <= b for a, b in NO_ROOM) else 2 if any(a <= u <= b for a, b in DOUBLE) else 1


def units(text: str) -> int:
    return sum(map(_unit, text))


def width(text: str, font: float) -> float:
    return units(text) * ADVANCE * font


def truncate(text: str, budget: float) -> str:
    """At most `budget` units with an ellipsis; a file's ending and three characters before it stay if they fit."""
    ends = list(accumulate(map(_unit, text)))
    if not ends or ends[-1] <= budget:
        return text
    found = re.fullmatch(r"(?s).+?(.{0,3}\.[A-Za-z0-9]{1,6})", text)
    tail = found[1] if found and len(found[1]) + 4 <= budget else ""
    return f"{text[: bisect_right(ends, budget - 1 - len(tail))]}…{tail}"


def fit(text: str, most: float, font: float, least: float) -> tuple[str, float, bool]:
    """(text, font, truncated): the largest font that lets the text in, by tenths down to `least`, else the text is cut."""
    each = units(text) * ADVANCE
    tenths = (k / 10 for k in range(math.floor(font * 10), math.ceil(least * 10) - 1, -1))
    chosen = next((f for f in chain((font,), tenths, (least,)) if each * f <= most and f <= font), None)
    if chosen is not None:
        return text, chosen, False
    smallest = min(least, font)
    return truncate(text, max(math.floor(most / (ADVANCE * smallest)), 2)), smallest, True


def escaped(text: Column) -> Column:
    """Markup characters as entities."""
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(most - 1, 0)), F.lit("…")))


def number(value: Column) -> Column:
    """One decimal at most, no trailing zero, no negative zero."""
    text = F.regexp_replace(F.format_string("%.1f", value.cast("double")), r"\.0$", "")
    return F.when(text == "-0", "0").otherwise(text)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def plain_number(value: float) -> str:
    text = f"{value:.1f}".removesuffix(".0")
    return "0" if text == "-0" else text


@F.pandas_udf(StructType().add("text", StringType()).add("font", DoubleType()).add("truncated", BooleanType()))
def fit_text(text: pd.Series, most: pd.Series, font: pd.Series, least: pd.Series) -> pd.DataFrame:
    rows = [fit(t or "", m, f, s) for t, m, f, s in zip(text, most, font, least, strict=True)]
    return pd.DataFrame(rows, columns=["text", "font", "truncated"])


# The wiring record: version, node and edge counts, languages.


def varint(n: int) -> bytes:
    """One byte below 251; else a marker and two, four or eight bytes, low first."""
    if n < 251:
        return bytes([n])
    for marker, size in ((251, 2), (252, 4), (253, 8)):
        if n < 1 << 8 * size:
            return bytes([marker]) + n.to_bytes(size, "little")
    raise OverflowError(n)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    marker = raw[at]
    if marker < 251:
        return marker, at + 1
    size = {251: 2, 252: 4, 253: 8}.get(marker)
    if size is None or len(raw) < at + 1 + size:
        raise ValueError("not a number")
    return int.from_bytes(raw[at + 1 : at + 1 + size], "little"), at + 1 + size


def encode_wiring(version: int, nodes: int, edges: int, languages: list[str]) -> bytes:
    out = varint(version) + varint(nodes) + varint(edges) + varint(len(languages))
    return out + b"".join(varint(len(x.encode())) + x.encode() for x in languages)


def decode_wiring(raw: bytes) -> tuple[int, int, int, list[str]] | None:
    """The record, or None for anything cut short, malformed or followed by more bytes."""
    try:
        numbers, at = [], 0
        for _ in range(4):
            n, at = read_varint(raw, at)
            numbers.append(n)
        languages = []
        for _ in range(numbers[3]):
            n, at = read_varint(raw, at)
            if at + n > len(raw):
                return None
            languages.append(raw[at : at + n].decode())
            at += n
    except (ValueError, IndexError):
        return None
    return (*numbers[:3], languages) if at == len(raw) else None


@F.pandas_udf(BinaryType())
def wiring_bytes(version: pd.Series, nodes: pd.Series, edges: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([encode_wiring(int(v), int(n), int(e), list(x)) for v, n, e, x in zip(version, nodes, edges, languages, strict=True)])
