"""Times as columns: what was written, the instant it means where that is certain, how exact it is, and how its zone is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\s*(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,]\d+)?)?)?)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?\s*$"


def parsed(instant: Column, original: Column, precision: Column, zone: Column) -> Column:
    return F.struct(instant.alias("instant"), original.alias("original"), precision.alias("precision"), zone.alias("zone"))


def from_unix_seconds(value: Column) -> Column:
    """Seconds as number or text; anything else is unknown, and what was written stays."""
    number = value.try_cast("double")
    instant = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 2.5e11), F.timestamp_micros(F.round(number * 1_000_000).cast("long")))
    known = instant.isNotNull()
    return parsed(instant, value.cast("string"), F.when(known, "second").otherwise("unknown"), F.when(known, "utc").otherwise("unknown"))


def from_iso(value: Column) -> Column:
    """ISO text. Without a zone the instant is unknown (naive), not UTC; fractions of a second are left out.

    Precision is the smallest field that is written, hours counting as minutes.
    """
    part = lambda i: F.nullif(F.regexp_extract(value, _ISO, i), F.lit(""))
    fits, tz = value.rlike(_ISO), part(7)
    zone = F.when(~fits, "unknown").when(tz.isNull(), "naive").when(tz == "Z", "utc").otherwise("offset")
    precision = F.when(~fits, "unknown").when(part(6).isNotNull(), "second").when(part(4).isNotNull(), "minute").when(part(3).isNotNull(), "day").when(part(2).isNotNull(), "month").otherwise("year")
    text = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), F.coalesce(part(4), F.lit("00")), F.lit(":"), F.coalesce(part(5), F.lit("00")), F.lit(":"), F.coalesce(part(6), F.lit("00")))
    wide = F.regexp_replace(F.when(tz == "Z", "+00:00").otherwise(tz), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    instant = F.when(fits & tz.isNotNull(), F.try_to_timestamp(F.concat(text, wide), F.lit("yyyy-MM-dd HH:mm:ssxxx")))
    return parsed(instant, value, precision, F.when(fits & tz.isNotNull() & instant.isNull(), "unknown").otherwise(zone))


def formatted(instant: Column) -> Column:
    """Fixed width, so that texts sort as times do. The session's zone must be UTC."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_or_zero(instant: Column) -> Column:
    return F.coalesce(F.unix_micros(instant) / 1_000_000, F.lit(0.0))


def version_key(updated: Column, created: Column) -> Column:
    return F.coalesce(updated, created)
