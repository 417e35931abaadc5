"""A walk over protobuf bytes without a schema: strings and references, within fixed bounds."""

from __future__ import annotations

import unicodedata

DEPTH, FIELDS, OUTPUT = 8, 100_000, 1 << 20


def fields(data: bytes) -> list[tuple[int, int, int | bytes]] | None:
    """(number, wire type, value) of a message; null where the bytes are none."""
    out, at = [], 0
    while at < len(data):
        key, at = _varint(data, at)
        if key is None or not key >> 3 or len(out) >= FIELDS:
            return None
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            if value is None:
                return None
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if at + size > len(data):
                return None
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        elif kind == 2:
            size, at = _varint(data, at)
            if size is None or at + size > len(data):
                return None
            value, at = data[at : at + size], at + size
        else:
            return None
        out.append((key >> 3, kind, value))
    return out


def _varint(data: bytes, at: int) -> tuple[int | None, int]:
    value = 0
    for k in range(10):
        if at >= len(data):
            return None, at
        b = data[at]
        at += 1
        value |= (b & 127) << 7 * k
        if b < 128:
            return (value if value < 1 << 64 else None), at
    return None, at


def readable(data: bytes) -> str | None:
    """Bytes as text if they are UTF-8 of two bytes or more, nine tenths of it printable."""
    if len(data) < 2:
        return None
    try:
        s = data.decode()
    except UnicodeDecodeError:
        return None
    good = sum(unicodedata.category(c) != "Cc" or c.isspace() for c in s)
    return s if good * 10 >= len(s) * 9 else None


def strings(data: bytes) -> list[str]:
    """The texts in a message and in those nested in it, in order, within the bounds."""
    out: list[str] = []
    stack, budget, seen = [(iter(fields(data) or ()), 0)], OUTPUT, 0
    while stack:
        step = next(stack[-1][0], None)
        if step is None:
            stack.pop()
            continue
        seen += 1
        if seen > FIELDS or budget <= 0:
            break
        if step[1] != 2:
            continue
        text = readable(step[2])
        if text is not None:
            text = text.encode()[:budget].decode("utf-8", "ignore")
            budget -= len(text.encode())
            out.append(text)
        elif stack[-1][1] + 1 < DEPTH and (inner := fields(step[2])):
            stack.append((iter(inner), stack[-1][1] + 1))
    return out


def references(data: bytes) -> list[str]:
    """Values of exactly 32 bytes at any depth, in order, as hex; a reference is not walked itself."""
    out: list[str] = []
    stack, seen = [iter(fields(data) or ())], 0
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            continue
        seen += 1
        if seen > FIELDS or len(out) * 32 >= OUTPUT:
            break
        if step[1] == 2 and len(step[2]) == 32:
            out.append(step[2].hex())
        elif step[1] == 2 and len(stack) < DEPTH and (inner := fields(step[2])):
            stack.append(iter(inner))
    return out


def is_tree_node(data: bytes) -> bool:
    """Whether a message is not empty and holds nothing but references and varints."""
    found = fields(data)
    return bool(found) and all(kind == 0 or kind == 2 and len(v) == 32 for _, kind, v in found)


def encode(rows: list[tuple[int, int | bytes]]) -> bytes:
    """A message of varints and byte strings, for tests and fixtures."""
    out = bytearray()
    for number, value in rows:
        for x in (number << 3 | (0 if isinstance(value, int) else 2), value if isinstance(value, int) else len(value)):
            while x > 127:
                out.append(x & 127 | 128)
                x >>= 7
            out.append(x)
        if not isinstance(value, int):
            out += value
    return bytes(out)
