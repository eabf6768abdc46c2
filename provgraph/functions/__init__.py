"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash60(text: Column) -> Column:
    """Sixty bits of the md5 digest as a long; any SQL engine gives the same."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(text: Column) -> Column:
    """A number in (0, 1] drawn from the text."""
    return (hash60(text) + 1).cast("double") / float(2**60)


def ns_to_timestamp(ns: Column) -> Column:
    """Nanoseconds as text to a timestamp; what is no number becomes null."""
    return F.timestamp_micros(ns_to_micros(ns))


def ns_to_micros(ns: Column) -> Column:
    return F.floor(ns.try_cast("bigint") / F.lit(1000).cast("decimal(20,0)")).cast("bigint")


def mask_events(text: Column, mark: str = "EVENT_MASKED") -> Column:
    """Replace event tokens that do not follow a word character."""
    return F.regexp_replace(text, r"(?<!\w)EVENT[^\s]*", mark)


def mask_events_in_array(texts: Column, mark: str = "EVENT_MASKED") -> Column:
    return F.transform(texts, lambda t: mask_events(t, mark))


def mask_events_in_map(texts: Column, mark: str = "EVENT_MASKED") -> Column:
    return F.transform_values(texts, lambda _, v: mask_events(v, mark))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is 0 where it is not defined."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def squared_error(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, x: s + x) / F.size(b)
