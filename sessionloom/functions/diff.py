"""Line diff by Myers' algorithm, with context and hunks; line ends are not part of a line."""

from __future__ import annotations

#: Bytes a side that are compared, at most.
MOST = 8 << 20


def edits(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """(tag, line in a, line in b) of every line: ' ' equal, '-' only in a, '+' only in b."""
    n, m = len(a), len(b)
    head = 0
    while head < n and head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    reach, trace = {1: 0}, []
    for d in range(len(x) + len(y) + 1):
        trace.append(dict(reach))
        done = False
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while i < len(x) and i - k < len(y) and x[i] == y[i - k]:
                i += 1
            reach[k] = i
            if i >= len(x) and i - k >= len(y):
                done = True
                break
        if done:
            break
    middle, i, j = [], len(x), len(y)
    for d in range(len(trace) - 1, -1, -1):
        k, old = i - j, trace[d]
        prev = k + 1 if k == -d or (k != d and old.get(k - 1, -1) < old.get(k + 1, -1)) else k - 1
        pi = old.get(prev, 0) if d else 0
        pj = pi - prev if d else 0
        while i > pi and j > pj and i > 0 and j > 0:
            i, j = i - 1, j - 1
            middle.append((" ", head + i, head + j))
        if d:
            if i == pi:
                j -= 1
                middle.append(("+", head + i, head + j))
            else:
                i -= 1
                middle.append(("-", head + i, head + j))
    same = [(" ", k, k) for k in range(head)]
    return [*same, *reversed(middle), *((" ", n - tail + k, m - tail + k) for k in range(tail))]


def hunks(old: str, new: str, context: int = 3) -> list[dict]:
    """Hunks with 1-based first lines and their lines."""
    a, b = ([x.rstrip("\r") for x in s.split("\n")] for s in (old, new))
    for s, lines in ((old, a), (new, b)):
        if s == "" or s.endswith("\n"):
            lines.pop()
    rows = edits(a, b)
    changed = [k for k, r in enumerate(rows) if r[0] != " "]
    out: list[dict] = []
    k = 0
    while k < len(changed):
        e = k
        while e + 1 < len(changed) and changed[e + 1] - changed[e] <= 2 * context + 1:
            e += 1
        part = rows[max(0, changed[k] - context) : changed[e] + context + 1]
        out.append({"old_start": part[0][1] + 1, "new_start": part[0][2] + 1, "lines": [t + (b[j] if t == "+" else a[i]) for t, i, j in part]})
        k = e + 1
    return out


def is_binary(data: bytes) -> bool:
    """Whether bytes hold a NUL near their beginning, or are no UTF-8 but for a sequence cut off at their end."""
    if b"\0" in data[:8192]:
        return True
    try:
        data.decode()
    except UnicodeDecodeError as e:
        return e.reason != "unexpected end of data"
    return False


def diffs(pairs, before: str = "before", after: str = "after", to: str = "diff"):
    """pairs with binary and the hunks between two contents (binary columns), as JSON text; binary or too large contents are not compared. A null content is an empty one."""
    import json

    from pyspark.sql import functions as F

    @F.pandas_udf("struct<binary:boolean,too_large:boolean,hunks:string>")
    def compare(old, new):
        import pandas as pd

        out = []
        for a, b in zip(old, new, strict=True):
            a, b = (bytes(x) if x is not None else b"" for x in (a, b))
            binary, large = is_binary(a) or is_binary(b), max(len(a), len(b)) > MOST
            out.append((binary, large, None if binary or large else json.dumps(hunks(a.decode(errors="replace"), b.decode(errors="replace")))))
        return pd.DataFrame(out, columns=["binary", "too_large", "hunks"])

    return pairs.withColumn(to, compare(before, after))
