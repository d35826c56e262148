"""Coercions, times, choices and documents as column functions."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import stripped


def whole(x: Column, default: int, least: int = 0, most: int | None = None) -> Column:
    """A whole number from a text or number, cut toward zero; the default where there is none; kept between limits."""
    value = F.greatest(F.coalesce(F.try_to_number(stripped(x.cast("string")), F.lit("S999999999999999999")).cast("bigint"), x.cast("string").try_cast("double").cast("bigint"), F.lit(default).cast("bigint")), F.lit(least).cast("bigint"))
    return value if most is None else F.least(value, F.lit(most).cast("bigint"))


def iso_utc(epoch: Column) -> Column:
    """Seconds as ISO text in UTC; empty for none, zero and less."""
    at = F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.timestamp_seconds(epoch).cast("timestamp_ntz"))
    return F.when(epoch > 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("")


def clock(epoch: Column, zone: str, form: str = "HH:mm:ss") -> Column:
    """The local time of day of a zone, or another form of it. The session's zone is UTC."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_seconds(epoch).cast("timestamp_ntz")), form)


def strict_time(x: Column) -> Column:
    """Seconds of an ISO text that names its offset; null without one."""
    offset = r"(Z|[+-]\d{2}:?\d{2})$"
    plain = F.regexp_replace(F.regexp_replace(stripped(x), r"^(\d{4}-\d{2}-\d{2}) ", "$1T"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    tried = [F.try_to_timestamp(plain, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")]
    return F.when(stripped(x).rlike(offset), F.unix_seconds(F.coalesce(*tried)))


def daily_minute(x: Column, default: int = 8 * 60 + 30) -> Column:
    """Minutes since midnight of HH:MM, the default where the text is no time of day."""
    parts = F.split(stripped(x), ":")
    hour, minute = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2))
    fits = (F.size(parts) == 2) & hour.between(0, 23) & minute.between(0, 59)
    return F.when(F.coalesce(fits, F.lit(False)), hour * 60 + minute).otherwise(default)


def safe_zone(x: Column, default: str = "Asia/Shanghai") -> Column:
    """The zone's name if it is a known one."""
    return F.when(stripped(x).isin(sorted(available_timezones())), stripped(x)).otherwise(default)


def day_of(*texts: Column) -> Column:
    """The first date yyyy-mm-dd that one of the texts holds, in their order; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(stripped(x), r"\d{4}-\d{2}-\d{2}", 0), F.lit("")) for x in texts])


def window_start(before: Column, now: Column, hours: int = 24) -> Column:
    """The last time something was sent, or else some hours ago."""
    return F.when(before > 0, before).otherwise(now - hours * 3600)


def filled(*choices: Column) -> Column:
    """The first choice that is not blank, stripped; empty if all are."""
    return F.coalesce(*[F.nullif(stripped(c), F.lit("")) for c in choices], F.lit(""))


def without_fence(x: Column) -> Column:
    """A reply without the code fence around it. The patterns of the fence."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(x), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def json_object(x: Column) -> Column:
    """The JSON object that a reply is or holds, as a variant; null without one."""
    plain = without_fence(x)
    inner = F.try_parse_json(F.regexp_extract(plain, r"\{[\s\S]*\}", 0))
    return F.coalesce(F.when(plain.startswith("{"), F.try_parse_json(plain)), inner)


def map_total(m: Column) -> Column:
    """The sum of a map's positive values."""
    return F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, v: a + F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)).cast("bigint"))


def merged(base: Column, patch: Column, kind: StructType) -> Column:
    """A document with a patch laid over it: a field that the patch fills wins, structs merge field by field."""
    fields = [merged(base[f.name], patch[f.name], f.dataType) if isinstance(f.dataType, StructType) else F.coalesce(patch[f.name], base[f.name]) for f in kind.fields]
    return F.when(patch.isNull(), base).otherwise(F.struct(*[c.alias(f.name) for c, f in zip(fields, kind.fields, strict=True)]))
