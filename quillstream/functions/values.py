"""Numbers, money, dates and identifiers as column expressions.

Operators: O-MTH-1, O-MTH-2, O-MTH-5, O-MTH-7 to O-MTH-12, O-DAT-1 to O-DAT-8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR, CEILING_SPAN = 0.32, 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """O-MTH-1: zero where either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def rescaled(cos: Column) -> Column:
    """O-MTH-2."""
    return F.when(cos <= FLOOR, 0.0).otherwise(F.least(F.lit(1.0), (cos - FLOOR) / CEILING_SPAN))


def percent_of(amount: Column, percent: Column) -> Column:
    """Half-up to cents, before anything else is multiplied (O-MTH-5)."""
    return F.round((amount * percent / 100).cast("decimal(38,10)"), 2)


def cell_number(c: Column) -> Column:
    """O-MTH-7."""
    return F.translate(F.trim(c), "%,₹", "").try_cast("decimal(18,4)")


def money(c: Column) -> Column:
    """O-MTH-8."""
    return F.format_number(c.cast("decimal(38,4)"), 2)


def trimmed_number(c: Column) -> Column:
    """O-MTH-8: no zeros behind the point."""
    return F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$|\.$", "$1").substr(F.lit(1), F.lit(60))


def indian_grouping(whole: Column) -> Column:
    """12,34,567 (O-MTH-8)."""
    return F.regexp_replace(whole.cast("string"), r"(?<=\d)(?=(\d\d)+\d$)", ",")


def byte_size(n: Column) -> Column:
    """Whole bytes, whole kilobytes (halves up), megabytes with one decimal (O-MTH-9)."""
    kb, mb = 1024, 1024 * 1024
    whole = F.floor(n / kb + F.lit(0.5)).cast("string")
    return F.when(n < kb, F.concat(n.cast("string"), F.lit(" B"))).when(n < mb, F.concat(whole, F.lit(" KB"))).otherwise(F.format_string("%.1f MB", n / mb))


def base36(n: Column) -> Column:
    """O-MTH-10."""
    return F.lower(F.conv(n.cast("string"), 10, 36))


def name_uuid(name: Column) -> Column:
    """Version 3 UUID of a name's bytes (O-MTH-11)."""
    h = F.md5(name)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def share_capped(used: Column, entitled: Column) -> Column:
    """O-MTH-12."""
    return F.when(entitled == 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * used / entitled)))


def local_day(ts: Column, zone: str) -> Column:
    """The calendar day of an instant in a zone (O-DAT-1)."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def parse_day(c: Column) -> Column:
    """O-DAT-3."""
    return F.to_date(F.try_to_timestamp(c, F.lit("d-MMM-yyyy")))


def month_key(c: Column) -> Column:
    """O-DAT-4."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.concat(F.lit("01-"), c), F.lit("dd-MMMM yyyy")), "yyyy-MM"), c)


def tenure_months(start: Column, end: Column) -> Column:
    """Whole calendar months (O-DAT-5)."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)


def tenure(start: Column, end: Column) -> Column:
    """``2 years 1 month`` (O-DAT-5)."""
    m = tenure_months(start, end)
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, F.lit("s")).otherwise("")))
    return F.concat_ws(" ", part(F.floor(m / 12), "year"), part(m % 12, "month"))


def ago(seconds: Column) -> Column:
    """O-DAT-6."""
    m = F.round(seconds / 60)
    h = F.round(m / 60)
    d = F.round(h / 24)
    s = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    return F.when(m < 1, F.lit("just now")).when(m < 60, s(m, "m ago")).when(h < 24, s(h, "h ago")).otherwise(s(d, "d ago"))


def since_days(ts: Column, now: Column, days: int) -> Column:
    """Whether an instant lies in the last ``days`` days before ``now`` (O-DAT-7)."""
    return ts >= before(now, days * 86400)


def before(ts: Column, seconds: int) -> Column:
    """An instant less a duration (O-DAT-8)."""
    return ts - F.make_dt_interval(secs=F.lit(seconds))
