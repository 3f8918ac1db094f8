"""Dates and times: claims with a precision, local days, decay.  Nothing reads a clock: ``as_of`` is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "january february march april may june july august september october november december".split()


def parse_date_claim(text: Column, loose: bool = False) -> Column:
    """struct(precision, date, date_start, date_end, raw) of a claim: exact, month, quarter, year or tbd.

    ``loose`` also takes "2026 Q3" for a quarter.
    """
    raw = F.trim(F.coalesce(text, F.lit("")))
    quarter = r"(?i)^Q([1-4])\s+(\d{4})$"
    q, qy = F.regexp_extract(raw, quarter, 1), F.regexp_extract(raw, quarter, 2)
    if loose:
        other = r"(?i)^(\d{4})\s+Q([1-4])$"
        q, qy = F.when(q != "", q).otherwise(F.regexp_extract(raw, other, 2)), F.when(qy != "", qy).otherwise(F.regexp_extract(raw, other, 1))
    month = r"^([A-Za-z]+)\s+(\d{4})$"
    names = F.array(*map(F.lit, _MONTHS))
    m, my = F.array_position(names, F.lower(F.regexp_extract(raw, month, 1))), F.regexp_extract(raw, month, 2)
    first = lambda y, mo: F.try_to_date(F.concat_ws("-", y, F.lpad(mo.cast("string"), 2, "0"), F.lit("01")))
    q_from, q_to = first(qy, q.cast("int") * 3 - 2), F.last_day(first(qy, q.cast("int") * 3))
    exact = F.coalesce(F.try_to_date(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})", 1)), F.try_to_date(raw, "MMM d, yyyy"), F.try_to_date(raw, "d MMM, yyyy"), F.try_to_date(raw, "MMMM d, yyyy"))
    year = raw.rlike(r"^\d{4}$")
    precision = F.when(q != "", "quarter").when(m > 0, "month").when(year, "year").when(exact.isNotNull(), "exact").otherwise("tbd")
    start = F.when(q != "", q_from).when(m > 0, first(my, m)).when(year, first(raw, F.lit("1"))).otherwise(exact)
    end = F.when(q != "", q_to).when(m > 0, F.last_day(first(my, m))).when(year, F.last_day(first(raw, F.lit("12")))).otherwise(exact)
    return F.struct(precision.alias("precision"), F.when(precision == "exact", exact).alias("date"), start.alias("date_start"), end.alias("date_end"), raw.alias("raw"))


def publication_fields(text: Column, zone: str = "Europe/Moscow") -> Column:
    """struct(instant, day, minute) of a time in text: an offset in the text gives the local day and time, else ``zone`` does."""
    instant = F.try_to_timestamp(text)
    offset = F.regexp_extract(text, r"([+-]\d{2}:\d{2})$", 1)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    minutes = F.when(offset != "", sign * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")))
    local = F.when(offset != "", F.timestamp_seconds(F.unix_timestamp(instant) + minutes * 60)).otherwise(F.from_utc_timestamp(instant, zone))
    return F.struct(instant.alias("instant"), F.date_format(local, "yyyy-MM-dd").alias("day"), F.date_format(local, "HH:mm").alias("minute"))


def age_hours(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9


def recency(ts: Column, as_of: Column, window_h: float = 96, half_life_h: float = 24) -> Column:
    """0.5 to the power of age over half-life; 0 beyond the window, in the future by no more than that, or without a time."""
    age = F.greatest(F.lit(0.0), age_hours(ts, as_of))
    return F.when(ts.isNotNull() & (age <= window_h), F.pow(F.lit(0.5), age / half_life_h)).otherwise(0.0)


def within(ts: Column, as_of: Column, hours: float) -> Column:
    """Whether a time lies in the last ``hours`` before ``as_of``."""
    return (ts >= as_of - F.make_dt_interval(F.lit(0), F.lit(int(hours)))) & (ts <= as_of)


def released(status: Column, date: Column, as_of: Column) -> Column:
    """struct(released, reason) by a status text, then by the date."""
    early = status.rlike(r"(?i)upcoming|announced|tba|tbd|coming soon|анонс|ожида")
    ok = ~F.coalesce(early, F.lit(False)) & (F.coalesce(date <= as_of.cast("date"), F.lit(True)))
    reason = F.when(F.coalesce(early, F.lit(False)), "status").when(date > as_of.cast("date"), F.when(F.year(date) > F.year(as_of), "future_year").otherwise("future_date")).otherwise("released")
    return F.struct(ok.alias("released"), reason.alias("reason"))
