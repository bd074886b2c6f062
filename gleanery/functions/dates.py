"""Date columns. Everything is TIMESTAMP_NTZ in UTC, computed without the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.once import bound
from gleanery.functions.text import clean_text

# Date shapes looked for in pages.
ISO_DATE = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
_TEXT_DATE = r"[A-Z][a-z]+\s+\d{1,2},\s+\d{4}\s+\d{1,2}:\d{2}\s*[AP]M"
VISIBLE_DATES = (
    rf"(?:Updated|Published)\s+on\s+({_TEXT_DATE})",
    rf"(?:Updated|Published)\s*:?\s*({_TEXT_DATE})",
)
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
# RFC 822 zone names, in hours.
ZONE_HOURS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}


def _literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def _shift(local: Column, offset: Column) -> Column:
    """``local`` minus an offset text like ``+05:30``; an empty offset is UTC."""

    def minutes(text: Column) -> Column:
        sign = F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
        part = [F.regexp_extract(text, r"^[+-](\d{2}):?(\d{2})$", n).try_cast("int") for n in (1, 2)]
        return F.when(text == "", F.lit(0)).otherwise(sign * (part[0] * 60 + part[1]))

    def shifted(total: Column) -> Column:
        return F.when(F.abs(total) < 24 * 60, local - F.make_dt_interval(F.lit(0), F.lit(0), total))

    return bound(bound(offset, minutes), shifted)


def iso_datetime(text: Column) -> Column:
    """First ISO date-time inside ``text``; without a zone it is UTC."""
    shape = r"^(\S{19})(?:\.(\d{1,6})\d*)?([+-].*)?$"

    def parsed(found: Column) -> Column:
        fraction = F.regexp_extract(found, shape, 2)
        local = F.concat_ws(".", F.regexp_extract(found, shape, 1), F.nullif(fraction, F.lit("")))
        offset = F.regexp_extract(found, shape, 3)
        return F.when(found != "", _shift(local.try_cast("timestamp_ntz"), offset))

    whole = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    return bound(F.regexp_extract(whole, f"({ISO_DATE})", 1), parsed)


def text_datetime(text: Column) -> Column:
    """``March 5, 2024`` or ``Mar 5, 2024``, with or without ``7:05 PM``, taken as UTC."""
    shape = r"^([A-Za-z]+) (\d{1,2}), (\d{4})(?: (\d{1,2}):(\d{1,2}) ([AaPp])[Mm])?$"
    months = {name: n for n, name in enumerate(MONTHS, 1)}
    months.update({name[:3]: n for name, n in list(months.items())})

    def part(n: int) -> Column:
        return F.regexp_extract(text, shape, n)

    month = F.element_at(_literal_map(months), F.lower(part(1)))
    has_time = part(6) != ""
    hour12 = part(4).try_cast("int")
    hour = F.when(
        has_time & hour12.between(1, 12),
        hour12 % 12 + F.when(F.lower(part(6)) == "p", F.lit(12)).otherwise(F.lit(0)),
    ).when(~has_time, F.lit(0))
    minute = F.when(has_time, part(5).try_cast("int")).otherwise(F.lit(0))
    return F.try_make_timestamp_ntz(
        part(3).try_cast("int"), month, part(2).try_cast("int"), hour, minute, F.lit(0).cast("decimal(8,6)")
    )


def parse_datetime(value: Column) -> Column:
    """ISO date inside the text, else the whole text in one of four written forms, else null."""
    return bound(clean_text(value), lambda text: F.coalesce(iso_datetime(text), text_datetime(text)))


def first_datetime(values: Column) -> Column:
    """First value of an array of texts that parses."""
    return F.get(F.filter(F.transform(values, parse_datetime), lambda d: d.isNotNull()), F.lit(0))


def feed_datetime(value: Column) -> Column:
    """Feed date, RFC 822 (zone names have fixed offsets) or ISO."""
    text = clean_text(value)
    shape = r"(\d{1,2}) ([A-Za-z]{3})[A-Za-z]* (\d{4}) (\d{1,2}):(\d{2})(?::(\d{2}))? ?([+-]\d{4}|[A-Za-z]+)?"

    def part(n: int) -> Column:
        return F.regexp_extract(text, shape, n)

    months = _literal_map({name[:3]: n for n, name in enumerate(MONTHS, 1)})
    zone = F.upper(part(7))
    offset = F.when(zone.rlike("^[+-]"), zone).otherwise(
        F.element_at(
            F.create_map(
                *[
                    F.lit(x)
                    for name, h in ZONE_HOURS.items()
                    for x in (name, f"{'-' if h < 0 else '+'}{abs(h):02d}00")
                ]
            ),
            zone,
        )
    )
    offset = F.coalesce(offset, F.lit(""))
    seconds = F.coalesce(part(6).try_cast("int"), F.lit(0)).cast("decimal(8,6)")
    local = F.try_make_timestamp_ntz(
        part(3).try_cast("int"),
        F.element_at(months, F.lower(part(2))),
        part(1).try_cast("int"),
        part(4).try_cast("int"),
        part(5).try_cast("int"),
        seconds,
    )
    return F.coalesce(_shift(local, offset), iso_datetime(text))


def to_utc(instant: Column) -> Column:
    """A zone-aware TIMESTAMP as zone-less UTC, whatever the session zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def date_label(as_of: Column) -> Column:
    """``March 05, 2024``."""
    return F.date_format(as_of, "MMMM dd, yyyy")
