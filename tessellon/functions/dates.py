"""Dates from text. The day is that of the text's own zone unless told otherwise; `as_of` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names' abbreviations, and the forms of dates that are read, in turn.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.left(name, F.lit(3)))).cast("string")


def parse_day(text: Column) -> Column:
    """RFC 822 ("Wed, 05 Mar 2025 10:00:00 GMT"), ISO (with or without a time), "March 5, 2025", "5 March 2025" and "03/05/2025"."""
    t = F.trim(text)
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:$|[T ].*)"
    rfc = r"^(?:[A-Za-z]{3,9},\s*)?(\d{1,2})\s+([A-Za-z]{3,9})\.?\s+(\d{4})(?:$|\s.*)"
    us = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})$"
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    g = lambda p, k: F.regexp_extract(t, p, k)
    return F.coalesce(
        F.when(t.rlike(iso), _day(g(iso, 1), g(iso, 2), g(iso, 3))),
        F.when(t.rlike(rfc), _day(g(rfc, 3), _month(g(rfc, 2)), g(rfc, 1))),
        F.when(t.rlike(us), _day(g(us, 3), _month(g(us, 1)), g(us, 2))),
        F.when(t.rlike(slash), _day(g(slash, 3), g(slash, 1), g(slash, 2))),
    )


def utc_day(text: Column) -> Column:
    """The UTC day of an RFC 822 or ISO time with an offset; without one, the day as written."""
    stamp = F.coalesce(
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]+,\\s*", ""), "(?:GMT|UTC)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
    )
    return F.coalesce(stamp.cast("date"), parse_day(text))


def sane(day: Column, as_of: Column, first: str = "1999-01-01") -> Column:
    """Null for days after as_of or before `first`."""
    return F.when((day <= as_of) & (day >= F.lit(first).cast("date")), day)


def age_days(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day)


def within_months(day: Column, as_of: Column, months: int) -> Column:
    return age_days(day, as_of) <= 30 * months + 5


def recency(day: Column, as_of: Column, horizon: int = 730, unknown: float = 0.3) -> Column:
    """1 today, 0 after the horizon; a day in the future gives more than 1."""
    return F.when(day.isNull(), unknown).otherwise(F.greatest(F.lit(0.0), 1.0 - age_days(day, as_of) / F.lit(float(horizon))))
