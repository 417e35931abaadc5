"""JSON by its own characters: members and elements with their places, so that order and numbers stay as they are written. As pandas UDFs, since no built-in function keeps places."""

from __future__ import annotations

import datetime
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import diff

_SPACE = re.compile(r"[ \t\r\n]*")
_DECODER = json.JSONDecoder()
_SPANS = T.ArrayType(T.StructType().add("offset", T.LongType()).add("length", T.LongType()).add("text", T.StringType()))
_HUNKS = T.ArrayType(T.StructType().add("old_start", T.IntegerType()).add("new_start", T.IntegerType()).add("lines", T.ArrayType(T.StringType())))


def members(s: str, at: int = 0) -> list[tuple[str, int, int]]:
    """(key, start, end) of the values of the object that begins at `at`."""
    out, at = [], _SPACE.match(s, _open(s, at, "{")).end()
    while s[at] != "}":
        key, at = _DECODER.raw_decode(s, at)
        begin = _SPACE.match(s, _SPACE.match(s, at).end() + 1).end()
        _, end = _DECODER.raw_decode(s, begin)
        out.append((key, begin, end))
        at = _next(s, end)
    return out


def elements(s: str, at: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the elements of the array that begins at `at`."""
    out, at = [], _SPACE.match(s, _open(s, at, "[")).end()
    while s[at] != "]":
        _, end = _DECODER.raw_decode(s, at)
        out.append((at, end))
        at = _next(s, end)
    return out


def _open(s: str, at: int, mark: str) -> int:
    at = _SPACE.match(s, at).end()
    if s[at : at + 1] != mark:
        raise ValueError(f"no {mark}")
    return at + 1


def _next(s: str, end: int) -> int:
    at = _SPACE.match(s, end).end()
    return _SPACE.match(s, at + 1).end() if s[at] == "," else at


def attributes_of(s: str | None) -> str | None:
    """A record without its tool result and its message's content; the rest of the message stays unless it is empty."""
    try:
        found = members(s or "")
    except (ValueError, IndexError):
        return None
    out = []
    for key, b, e in found:
        value = s[b:e]
        if key == "toolUseResult":
            continue
        if key == "message":
            if not value.startswith("{"):
                continue
            rest = [f"{json.dumps(k, ensure_ascii=False)}:{value[x:y]}" for k, x, y in members(value) if k != "content"]
            if not rest:
                continue
            value = "{" + ",".join(rest) + "}"
        out.append(f"{json.dumps(key, ensure_ascii=False)}:{value}")
    return "{" + ",".join(out) + "}"


def without(s: str | None, dropped: str) -> str | None:
    """An object without the members named in a list parted by spaces."""
    try:
        found = members(s or "")
    except (ValueError, IndexError):
        return None
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{s[b:e]}" for k, b, e in found if k not in dropped.split()) + "}"


def entry_spans(s: str | None, key: str = "entries") -> list[dict]:
    """Byte places of the elements of an array member."""
    try:
        at = next(b for k, b, _ in members(s or "") if k == key)
        found = elements(s, at)
    except (ValueError, IndexError, StopIteration):
        return []
    out, last, size = [], 0, 0
    for b, e in found:
        size += len(s[last:b].encode())
        length = len(s[b:e].encode())
        out.append({"offset": size, "length": length, "text": s[b:e]})
        last, size = e, size + length
    return out


def embedded_time(s: str | None) -> str | None:
    """UTC time of text such as 'Friday, Jan 2, 2026, 3:04 PM (UTC+1)', the month short or in full; null without a zone or where the weekday is wrong."""
    m = re.fullmatch(r"(\w+), (\w+) (\d{1,2}), (\d{4}), (\d{1,2}):(\d{2}) ([AaPp][Mm]) \(UTC(?:([+-])(\d{1,2})(?::(\d{1,2}))?)?\)", (s or "").strip())
    for month in ("%b", "%B") if m else ():
        try:
            at = datetime.datetime.strptime(" ".join(m.group(2, 3, 4, 5, 6, 7)), f"{month} %d %Y %I %M %p")
            east = datetime.timedelta(hours=int(m[9] or 0), minutes=int(m[10] or 0)) * (-1 if m[8] == "-" else 1)
            if at.strftime("%A") == m[1] and abs(east) < datetime.timedelta(days=1):
                return (at - east).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        except (ValueError, OverflowError):
            continue
    return None


def percent_encode(raw: bytes) -> tuple[str, bool]:
    """A path as text, and whether bytes that are no UTF-8 had to be written as %XX (with % itself as %25)."""
    try:
        return raw.decode(), False
    except UnicodeDecodeError:
        kept = raw.replace(b"%", b"%25").decode("utf-8", "surrogateescape")
        return "".join(f"%{ord(c) - 0xDC00:02X}" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in kept), True


def percent_decode(path: str, encoded: bool) -> bytes:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), path.encode()) if encoded else path.encode()


@F.pandas_udf(T.StringType())
def attributes_udf(s: pd.Series) -> pd.Series:
    return s.map(attributes_of)


@F.pandas_udf(T.StringType())
def without_udf(s: pd.Series, dropped: pd.Series) -> pd.Series:
    return pd.Series([without(x, d) for x, d in zip(s, dropped, strict=True)])


@F.pandas_udf(_SPANS)
def entry_spans_udf(s: pd.Series) -> pd.Series:
    return s.map(entry_spans)


@F.pandas_udf(T.StringType())
def embedded_time_udf(s: pd.Series) -> pd.Series:
    return s.map(embedded_time)


@F.pandas_udf(_HUNKS)
def diff_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Hunks between two texts; longer ones than 8 MiB are not compared."""
    return pd.Series([None if x is None or y is None or max(len(x), len(y)) > 8 << 20 else diff.hunks(x, y) for x, y in zip(a, b, strict=True)])
