"""Timestamps as they are stored: UTC with milliseconds, YYYY-MM-DDTHH:MM:SS.mmmZ."""

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def stored(ts: Column) -> Column:
    """A timestamp as text; digits below a millisecond are cut off. The session's time zone must be UTC."""
    return F.date_format(F.date_trunc("MILLISECOND", ts), FORMAT)


def parse(text: Column) -> Column:
    """The timestamp of RFC 3339 text with an offset; null for anything else, also where Spark alone would accept it."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(text)))


def normalise(text: Column) -> Column:
    return stored(parse(text))


def from_millis(ms: Column) -> Column:
    return stored(F.timestamp_millis(ms.cast("long")))


def lenient(text: Column) -> Column:
    """Epoch milliseconds as an integer or decimal number, or RFC 3339 text."""
    return F.when(text.rlike(r"^-?\d{1,15}(\.\d+)?$"), from_millis(F.regexp_extract(text, r"^-?\d+", 0).cast("long"))).otherwise(normalise(text))


def day_start(bound: Column) -> Column:
    """A bound of a range: a bare date means its first millisecond."""
    return F.when(F.length(bound) == 10, F.concat(bound, F.lit("T00:00:00.000Z"))).otherwise(bound)


def day_end(bound: Column) -> Column:
    return F.when(F.length(bound) == 10, F.concat(bound, F.lit("T23:59:59.999Z"))).otherwise(bound)
