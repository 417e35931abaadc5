"""Operator 9: format-preserving pseudonyms for numbers, dates and addresses.

What looks like a card number, bank account, social security number, telephone number, IP address,
date, mail address or assigned secret is validated (check digits, ranges, calendar) and then
permuted within its own format by a Feistel network whose rounds are keyed hashes: the alphabet,
length and punctuation stay, check digits hold, dates stay dates. As it is a permutation with one key, equal
values get equal pseudonyms in every document and different values different ones, and whoever holds the key can undo it.
What fails validation is left as it is. Not looked for are dates with names of months or years of two digits, and telephone
numbers whose groups are parted by spaces alone without a + before them: too many other numbers look like that.

The key is an argument or stands in the configuration, as spark.sessionloom.pseudonym.secret. Without either one is drawn at random for
the application and kept nowhere: pseudonyms are then linked within that application's results, and nobody can undo them.

One pass without a shuffle. Null texts stay null; empty ones empty. Texts of any length are searched
whole. Rows are treated each on its own; further columns are passed on, one named as the result is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

#: The setting that holds the key.
SECRET = "spark.sessionloom.pseudonym.secret"

_drawn: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The configured key, or one drawn once for each application."""
    if named := spark.conf.get(SECRET, None):
        return named.encode()
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


SPANS = "array<struct<kind:string,start:int,end:int>>"

_ANY = re.compile(r"[0-9@]")
_FORMATS = [
    ("date", r"(?<![\w./-])(?:\d{4}(?P<a>[-/.])\d{1,2}(?P=a)\d{1,2}|\d{1,2}(?P<b>[-/.])\d{1,2}(?P=b)\d{4})(?!(?!T\d\d:?\d\d)[\w/-])(?!\.\d)"),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])(?!\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w-])(?:\d{13,19}|\d{4}(?P<c>[ -])\d{4}(?P=c)\d{4}(?P=c)\d{4}|\d{4}(?P<d>[ -])\d{6}(?P=d)\d{5})(?![\w-])"),
    ("phone", r"(?<![\w+(])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}(?P<e>[.-])\d{3}(?P=e)\d{4})(?![\w])"),
    ("iban", r"(?<!\w)[A-Za-z]{2}\d{2}(?:[A-Za-z0-9]{11,30}|(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?)(?!\w)"),
    ("secret", r"(?i:(?<=token|.word|ecret|i_key|i-key|pikey)\s{0,3}[:=]\s{0,3}[\"']?)(?=[^\s\"']*\d)[A-Za-z0-9_+/-]{16,}"),
]
_NUMBERS = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _FORMATS))
_LOCAL, _HOST = re.compile(r"[\w.+-]+\Z"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ASSIGNED = re.compile(r"\s*[:=]\s*[\"']?")
_DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of 0 .. n - 1 for any n, each with its own tweak."""

    rounds = 8

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _walk(self, x: int, n: int, tweak: str, back: bool) -> int:
        a = math.isqrt(n - 1) + 1 if n > 1 else 1
        b = -(-n // a)
        while True:  # cycle walking: a * b is hardly more than n
            left, right = divmod(x, b)
            for r in reversed(range(self.rounds)) if back else range(self.rounds):
                if r % 2:
                    left = (left + (-1 if back else 1) * self._round(r, right, tweak, n)) % a
                else:
                    right = (right + (-1 if back else 1) * self._round(r, left, tweak, n)) % b
            x = left * b + right
            if x < n:
                return x

    def _round(self, r: int, x: int, tweak: str, n: int) -> int:
        size = max(16, (n.bit_length() + 7) // 8 + 8)
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(f"{tweak}|{n}|{r}|{x}|{block}".encode(), key=self.key, digest_size=min(64, size)).digest()
            block += 1
        return int.from_bytes(out[:size], "big")

    def permute(self, x: int, n: int, tweak: str) -> int:
        return self._walk(x, n, tweak, False)

    def undo(self, x: int, n: int, tweak: str) -> int:
        return self._walk(x, n, tweak, True)


def luhn(digits: str) -> int:
    """The digit that must follow digits."""
    return -sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


class Pseudonyms:
    """The pseudonym of each kind of value; back: of the pseudonym, the value."""

    def __init__(self, key: bytes, back: bool = False):
        feistel = Feistel(key)
        self.walk = feistel.undo if back else feistel.permute

    def fill(self, text: str, which: list[bool], kind: str) -> str:
        """text with its marked letters and digits permuted, each within its class; case stays in place."""
        radix = [10 if c.isdigit() else 26 for c, w in zip(text, which, strict=True) if w]
        x = 0
        for c, r in zip((c for c, w in zip(text, which, strict=True) if w), radix, strict=True):
            x = x * r + (int(c) if r == 10 else ord(c.lower()) - 97)
        x = self.walk(x, math.prod(radix), kind + "".join("d" if r == 10 else "l" for r in radix))
        new = []
        for r in reversed(radix):
            x, d = divmod(x, r)
            new.append(str(d) if r == 10 else chr(97 + d))
        return "".join((n.upper() if c.isupper() else n) if w and (n := new.pop()) else c for c, w in zip(text, which, strict=True))

    def digits(self, text: str, kind: str, skip: int = 0) -> str:
        seen, which = 0, []
        for c in text:
            which.append(c.isdigit() and seen >= skip)
            seen += c.isdigit()
        return self.fill(text, which, kind)

    def card(self, text: str) -> str | None:
        d = re.sub(r"\D", "", text)
        if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        new = self.digits(d[:-1], "card")
        new = iter(new + str(luhn(new)))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def iban(self, text: str) -> str | None:
        s = text.replace(" ", "").upper()
        if not 15 <= len(s) <= 34 or not s[2:4].isdigit() or _iban_rest(s) != 1 or not 2 <= int(s[2:4]) <= 98:
            return None
        body = self.fill(s[4:], [True] * (len(s) - 4), "iban" + s[:2])
        new = iter(f"{s[:2]}{98 - _iban_rest(s[:2] + '00' + body):02d}{body}")
        return "".join(c if c == " " else (n.lower() if c.islower() else n) for c in text if c == " " or (n := next(new)))

    def ssn(self, text: str) -> str | None:
        a, b, c = map(int, text.split("-"))
        if a in (0, 666) or a > 899 or not b or not c:
            return None
        x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
        x, c = divmod(self.walk(x, 898 * 99 * 9999, "ssn"), 9999)
        a, b = divmod(x, 99)
        return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"

    def phone(self, text: str) -> str | None:
        d, country = re.sub(r"\D", "", text), re.match(r"\+(\d{1,3})", text)
        skip = len(country[1]) if country else 0
        if not 8 <= len(d) <= 15 or len(d) - skip < 6:
            return None
        return self.digits(text, "phone", skip)

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.walk(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        mark = re.search(r"\D", text)[0]
        parts = text.split(mark)
        orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy")
        for order in orders:
            named = dict(zip(order, map(int, parts), strict=True))
            try:
                day = datetime.date(named["y"], named["m"], named["d"]).toordinal()
            except ValueError:
                continue
            if not _DAYS[0] <= day <= _DAYS[1]:
                return None
            padded = all(len(p) >= 2 for p in parts)
            # without leading zeros days and months of two figures stay so, or equal pseudonyms would not tell their format
            new = datetime.date.fromordinal(_DAYS[0] + self.walk(day - _DAYS[0], _DAYS[1] - _DAYS[0] + 1, "date"))
            of = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month), "d": f"{new.day:02d}" if padded else str(new.day)}
            return mark.join(of[k] for k in ("ymd" if orders == ("ymd",) else "dmy" if order == "dmy" else "mdy"))
        return None

    def mail(self, text: str) -> str:
        local = text[: text.index("@")]
        which = [c.isascii() and c.isalnum() for c in local]
        return (self.fill(local, which, "mail") if any(which) else local) + text[len(local) :]

    def secret(self, text: str) -> str:
        at = _ASSIGNED.match(text).end()
        body = text[at:]
        if re.fullmatch(r"[0-9a-fA-F]+", body):
            x = f"{self.walk(int(body, 16), 16 ** len(body), 'hex'):0{len(body)}x}"
            return text[:at] + (x.upper() if any(c.isupper() for c in body) else x)
        return text[:at] + self.fill(body, [c.isascii() and c.isalnum() for c in body], "secret")

    def apply(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of what was replaced, in characters of the old text."""
        if not text or not _ANY.search(text):
            return text, []
        found, taken = [], []
        at = text.find("@")
        while at >= 0:
            host = _HOST.match(text, at + 1)
            back = max(0, at - 64)
            local = _LOCAL.search(text, back, at) if host else None
            if local and local.start() < at:
                b = local.start()
                while b < at and text[b] in ".+-":
                    b += 1
                e = host.end()
                if b < at:
                    taken.append((b, e))
                    found.append(("mail", b, e, self.mail(text[b:e])))
            at = text.find("@", at + 1)
        spans = iter(taken)
        span = next(spans, None)
        place = 0
        while m := _NUMBERS.search(text, place):
            while span and span[1] <= m.start():
                span = next(spans, None)
            if span and span[0] < m.end():
                place = max(span[1], m.start() + 1)
                continue
            new = getattr(self, m.lastgroup)(m[0])
            if new is None:
                place = m.start() + 1
                while place < len(text) and text[place - 1].isdigit() and text[place].isdigit():
                    place += 1
                continue
            shift = _ASSIGNED.match(m[0]).end() if m.lastgroup == "secret" else 0
            found.append((m.lastgroup, m.start() + shift, m.end(), new[shift:]))
            place = m.end()
        found.sort(key=lambda x: x[1])
        out, last = [], 0
        for _, b, e, new in found:
            out += [text[last:b], new]
            last = e
        return "".join([*out, text[last:]]), [x[:3] for x in found]


def pseudonymise(docs: DataFrame, key: bytes | None = None, text: str = "text", spans: str = "pii", back: bool = False) -> DataFrame:
    """docs with pseudonyms in its texts and a column of what was replaced: kind, start, end in the old text."""
    prepare(docs.sparkSession)
    docs, key = docs.drop(spans), key_of(docs.sparkSession) if key is None else key

    def run(batches):
        names = Pseudonyms(key, back)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            done = [names.apply(x) for x in batch.column(at).to_pylist()]
            columns = [pa.array([x for x, _ in done], pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            marks = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for _, x in done], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns, marks], names=[*batch.schema.names, spans])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(spans, T._parse_datatype_string(SPANS))]))


def replaced(docs: DataFrame) -> DataFrame:
    """doc_id, n_found, kinds, text (with pseudonyms) of every row of docs (doc_id, text)."""
    done = pseudonymise(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return done.select("doc_id", F.size("pii").cast("long").alias("n_found"), F.array_sort(F.array_distinct("pii.kind")).alias("kinds"), "text")
