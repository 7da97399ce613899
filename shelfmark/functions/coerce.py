"""Value coercers: columns that give null where a raw value does not fit."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit, category, factor to the category's base unit.
UNITS = [
    ("bps", "DataRate", 1.0), ("bit/s", "DataRate", 1.0), ("kbps", "DataRate", 1e3), ("kbit/s", "DataRate", 1e3), ("mbps", "DataRate", 1e6), ("mbit/s", "DataRate", 1e6), ("gbps", "DataRate", 1e9),
    ("b", "DataSize", 1.0), ("byte", "DataSize", 1.0), ("bytes", "DataSize", 1.0), ("kb", "DataSize", 1e3), ("mb", "DataSize", 1e6), ("gb", "DataSize", 1e9), ("tb", "DataSize", 1e12),
    ("kib", "DataSize", 2.0**10), ("mib", "DataSize", 2.0**20), ("gib", "DataSize", 2.0**30), ("tib", "DataSize", 2.0**40),
    ("hz", "Frequency", 1.0), ("khz", "Frequency", 1e3), ("mhz", "Frequency", 1e6), ("ghz", "Frequency", 1e9), ("fps", "FrameRate", 1.0),
]
# Machine types of portable executables.
PE_MACHINES = {332: "x86-32", 34404: "x86-64", 512: "IA-64", 43620: "ARM64", 448: "ARM", 452: "ARM-Thumb2"}

# Patterns of quantities and of numbers, and formats of dates.
QUANTITY = r"^([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)\s*([a-zA-Z/]+)?"
FLOAT = r"^[+-]?(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[XXX]", "yyyy-MM-dd HH:mm:ss[XXX]", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS[XXX]", "yyyy-MM-dd", "yyyy-MM", "yyyy")
EXIF_FORMATS = ("yyyy:MM:dd HH:mm:ss[XXX]", "yyyy:MM:dd")
#: Tried when the exact formats fail; a name of a weekday in front does not matter.
LENIENT_FORMATS = (
    "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd HH:mm[XXX]", "yyyy-MM-dd HH:mm:ss.SSSSSSSSS[XXX]", "yyyy/M/d[ HH:mm[:ss]]", "M/d/yyyy[ HH:mm[:ss]]",
    "d MMM yyyy[ HH:mm[:ss]][ XXX]", "d MMMM yyyy[ HH:mm[:ss]][ XXX]", "MMM d, yyyy[ HH:mm[:ss]]", "MMMM d, yyyy[ HH:mm[:ss]]",
)
# Fixed value: what a missing date is written as.
PLACEHOLDER_DATE = r"^\s*(?:0000|1904-01-01|1904:01:01|1970-01-01|1970:01:01)"


def strip(c: Column) -> Column:
    """Trimmed of all white space."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, ",", "")


def text(c: Column) -> Column:
    return c


def mime(c: Column) -> Column:
    """The essence of a content type, without parameters."""
    return F.nullif(strip(F.substring_index(strip(c), ";", 1)), F.lit(""))


def integer(c: Column) -> Column:
    v = strip(c)
    return F.when(v.rlike(r"^[+-]?[0-9][0-9,]*$"), _plain(v).try_cast("bigint"))


def floating(c: Column) -> Column:
    v = strip(c)
    return F.when(v.rlike(FLOAT), _plain(v).try_cast("double"))


def seconds(c: Column) -> Column:
    """A number of seconds, or a span of time."""
    return F.coalesce(floating(c), time_span(c))


#: [days and a dot] hours : minutes [: seconds], or days : hours : minutes : seconds.
_SPAN = r"^(-)?(?:(\d{1,8})\.)?(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d{1,7})?))?$"
_LONG_SPAN = r"^(-)?(\d{1,8}):(\d{1,2}):(\d{1,2}):(\d{1,2}(?:\.\d{1,7})?)$"


def time_span(c: Column) -> Column:
    """Seconds of a span of days, hours, minutes and seconds; hours, minutes and seconds stay in their range."""
    v = strip(c)
    one = lambda i: F.coalesce(F.nullif(F.when(v.rlike(_LONG_SPAN), F.regexp_extract(v, _LONG_SPAN, i)).otherwise(F.regexp_extract(v, _SPAN, i)), F.lit("")).try_cast("double"), F.lit(0.0))
    days, hours, minutes, secs = one(2), one(3), one(4), one(5)
    total = ((days * 24 + hours) * 60 + minutes) * 60 + secs
    return F.when((v.rlike(_SPAN) | v.rlike(_LONG_SPAN)) & (hours < 24) & (minutes < 60) & (secs < 60), F.when(v.startswith("-"), -total).otherwise(total))


def _clock(v: Column, parts: tuple[int, ...]) -> Column:
    split = F.split(v, ":", -1)
    total = F.aggregate(split, F.lit(0.0), lambda a, x: a * 60 + floating(x))
    return F.when(F.size(split).isin(*parts), total)


def duration(c: Column) -> Column:
    """Seconds of "90", "90s", "2:30.5" or "1:23:45", else of a span of time."""
    v = strip(c)
    number = F.regexp_replace(v, r"[sS]$", "")
    few = F.size(F.split(v, ":", -1)).isin(2, 3)
    return F.when(few, _clock(v, (2, 3))).when(F.contains(v, F.lit(":")), time_span(v)).otherwise(floating(number))


def quantity_number(c: Column) -> Column:
    return _plain(F.nullif(F.regexp_extract(strip(c), QUANTITY, 1), F.lit(""))).try_cast("double")


def quantity_unit(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(strip(c), QUANTITY, 2)), F.lit(""))


def in_unit(c: Column, category: str) -> Column:
    """A quantity in the base unit of its category; without a unit it is in that already."""
    factors = F.create_map(*[F.lit(x) for unit, of, factor in UNITS if of == category for x in (unit, factor)])
    unit = quantity_unit(c)
    return quantity_number(c) * F.when(unit.isNull(), F.lit(1.0)).otherwise(F.try_element_at(factors, unit))


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.bround(c).try_cast("bigint")


def integer_loose(c: Column) -> Column:
    return rounded(quantity_number(c))


def number(c: Column) -> Column:
    return quantity_number(c)


def factory_integer(c: Column) -> Column:
    """The leading quantity rounded, else a plain whole number; null rejects the value."""
    return F.coalesce(rounded(quantity_number(c)), integer(c))


def factory_float(c: Column) -> Column:
    return F.coalesce(quantity_number(c), floating(c))


def date_shape(form: str) -> str:
    """A pattern that all texts of a date format fit, and few others: a format that does not fit is dear to try.

    Years have five digits at most; of more, the time could not be told and would end the query.
    """
    parts = {"y": r"[+-]?\d{1,5}", "S": r"\d+", "X": r"\S+", "[": "(?:", "]": ")?"}
    out, i = "", 0
    while i < len(form):
        c = form[i]
        n = len(form[i:]) - len(form[i:].lstrip(c)) if c.isalpha() else 1
        if c == "'":
            end = form.index("'", i + 1)
            out, i = out + re.escape(form[i + 1 : end]), end + 1
            continue
        out += parts.get(c) or (r"[\p{L}.]+" if c == "M" and n > 2 else r"\d+" if c.isalpha() else re.escape(c))
        i += n
    return f"(?iu)^{out}$"


def _date(c: Column, formats: tuple[str, ...]) -> Column:
    # No more decimals than can be told; the rest is cut.
    v = F.regexp_replace(strip(c), r"(\.\d{9})\d+", "$1")
    plain = F.regexp_replace(F.regexp_replace(v, r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), r"\s+(?i:GMT|UTC)$", " Z")
    read = lambda text, form: F.when(text.rlike(date_shape(form)), F.try_to_timestamp(text, F.lit(form)))
    # A function of an array of one binds both texts, which are then told once for all formats, and keeps the generated code small.
    both = F.array(F.struct(v.alias("v"), plain.alias("plain")))
    return F.get(F.transform(both, lambda x: F.coalesce(*[read(x["v"], f) for f in formats], *[read(x["plain"], f) for f in LENIENT_FORMATS])), 0)


def iso_date(c: Column) -> Column:
    return _date(c, ISO_FORMATS)


def exif_date(c: Column) -> Column:
    return _date(c, EXIF_FORMATS + ISO_FORMATS)


def pe_machine(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for code, name in PE_MACHINES.items() for x in (code, name)])
    return F.try_element_at(names, integer(c).cast("int"))


def split_values(c: Column) -> Column:
    """Distinct parts between semicolons, trimmed, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ";", -1), strip), lambda x: x != ""))


def meaningful_tag(c: Column) -> Column:
    v = F.lower(strip(c))
    return (v != "") & ~v.isin("general", "unknown") & ~v.rlike(r"^\p{L}{2}$")


def real_date(c: Column) -> Column:
    """False for the usual placeholders of a missing date."""
    return ~c.rlike(PLACEHOLDER_DATE)


def placeholder_time(t: Column) -> Column:
    """True for year 1 and for times within two days of the epochs of 1904 and 1970."""
    near = lambda day: F.abs(F.unix_seconds(t) - F.unix_seconds(F.to_timestamp(F.lit(day)))) <= 2 * 86_400
    return (F.year(t) <= 1) | near("1970-01-01") | near("1904-01-01")


def disc_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)\s*[/\\]\s*(\d+)", 1), F.lit("")).try_cast("bigint")


def disc_total(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)\s*[/\\]\s*(\d+)", 2), F.lit("")).try_cast("bigint")


def stream_of_language(key: Column) -> Column:
    """n of a key IASn, which tells the language of stream n."""
    return F.nullif(F.regexp_extract(key, r"^IAS(\d+)$", 1), F.lit("")).try_cast("int")


def probe_duration(c: Column) -> Column:
    """Duration from a probe; more than seven decimals are cut."""
    return duration(F.regexp_replace(c, r"(\.\d{7})\d+", "$1"))


def attribute_name(c: Column) -> Column:
    """"snake_case" or "kebab-case" as "Sentence case"; names with capitals or spaces stay."""
    words = F.regexp_replace(c, r"[_-]+", " ")
    return F.when(c.rlike(r"^[a-z0-9]+(?:[_-][a-z0-9]+)*$"), F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))).otherwise(c)


TEXT_COERCERS = {"text": text, "mime": mime, "pe_machine": pe_machine}
INTEGER_COERCERS = {"integer": integer, "integer_loose": integer_loose, "integer_in_DataRate": lambda c: rounded(in_unit(c, "DataRate")), "integer_in_Frequency": lambda c: rounded(in_unit(c, "Frequency"))}
FLOAT_COERCERS = {"float": floating, "number": number, "duration": duration, "float_in_FrameRate": lambda c: in_unit(c, "FrameRate")}
DATE_COERCERS = {"iso_date": iso_date, "exif_date": exif_date}
