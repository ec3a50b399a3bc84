"""Timestamps in many notations to one UTC instant.

An ordered cascade of anchored patterns rewrites a value into the same fields; the first pattern that matches
decides, and a value that no pattern matches, or whose fields are no real date and time, is null. All is done in
built-in expressions and doesn't depend on the session's time zone.
"""

from __future__ import annotations

from dataclasses import dataclass
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import fold_digits, squeeze

DAY_US = 86_400_000_000

#: The usual offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "BST": 60, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420}
#: English month names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp][Mm])(?![A-Za-z]))?"
_ZONE = r"(Z|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+|[A-Z]{3,4}|[+-]\d{2}(?::?\d{2})?(?:\[[^\]]+\])?)"
_MONTH = r"([A-Za-z]{3})[a-z]*"


@dataclass(frozen=True)
class Notation:
    """A pattern and where its groups go: kind|a|b|year|hour|minute|second|fraction|am/pm|zone."""

    name: str
    pattern: str
    fields: str


#: In this order. a and b are day and month (`dmy`), month and day (`mdy`) or as the source says (`slash`).
CASCADE = [
    Notation("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ]{_CLOCK} ?{_ZONE}?)?$", "mdy|$2|$3|$1|$4|$5|$6|$7|$8|$9"),
    Notation("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:\.(\d{{1,9}}))?{_ZONE}?$", "mdy|$2|$3|$1|$4|$5|$6|$7||$8"),
    Notation("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_CLOCK}(?: ?{_ZONE})?)?$", "dmy|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    Notation("slashed", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_CLOCK}(?: ?{_ZONE})?)?$", "slash|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    Notation("mail", rf"^(?:[A-Za-z]{{3}}, ?)?(\d{{1,2}}) {_MONTH} (\d{{4}})(?: {_CLOCK}(?: ?{_ZONE})?)?$", "dmy|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    Notation("written", rf"^{_MONTH} (\d{{1,2}}), (\d{{4}})(?:,? {_CLOCK}(?: ?{_ZONE})?)?$", "mdy|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
]


def wall_micros(ntz: Column) -> Column:
    """A timestamp without zone as microseconds since 1970-01-01 read as UTC, whatever the session's zone."""
    clock = F.hour(ntz).cast("bigint") * 3600 + F.minute(ntz) * 60
    return F.unix_date(F.to_date(ntz)).cast("bigint") * DAY_US + clock * 1_000_000 + (F.date_part(F.lit("SECOND"), ntz) * 1_000_000).cast("bigint")


def _zone_shift(instant_us: Column, zone: Column) -> Column:
    """The wall clock of `zone` at an instant, as microseconds read as if they were UTC."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant_us), zone))


def local_to_utc(local_us: Column, zone: Column, ambiguous: str = "earlier", nonexistent: str = "before") -> Column:
    """A wall-clock time in an IANA zone as a UTC instant, both in microseconds.

    The offsets in force a day before and a day after give two readings. If both show the given wall clock and
    differ, it occurs twice: `ambiguous` is earlier, later or null. If neither shows it, the clocks skipped
    it: `nonexistent` is before (offset in force before the change), after or null.
    """
    if ambiguous not in ("earlier", "later", "null") or nonexistent not in ("before", "after", "null"):
        raise ValueError("unknown policy")
    day = F.lit(DAY_US)
    before = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us - day), zone)) + day
    after = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us + day), zone)) - day
    fits_before, fits_after = _zone_shift(before, zone) == local_us, _zone_shift(after, zone) == local_us
    twice = {"earlier": F.least(before, after), "later": F.greatest(before, after), "null": F.lit(None).cast("bigint")}[ambiguous]
    never = {"before": before, "after": after, "null": F.lit(None).cast("bigint")}[nonexistent]
    return (
        F.when(before == after, before)
        .when(fits_before & fits_after, twice)
        .when(fits_before, before)
        .when(fits_after, after)
        .otherwise(never)
    )


def utc_micros(
    value: Column, zone: Column, date_order: Column, ambiguous: str = "earlier", nonexistent: str = "before"
) -> Column:
    """Microseconds since 1970-01-01 UTC of a written timestamp, or null.

    All-digit values of 10, 13 or 16 digits are epoch seconds, milliseconds or microseconds. `zone` is the
    source's IANA zone, used where the value names neither offset nor zone; `date_order` (`dmy` or `mdy`) reads
    slashed dates. A date alone is local midnight. An offset wins over a zone in brackets beside it. Null, blank
    and unreadable values, impossible dates, and local times of a source without a known zone give null.
    """
    text = fold_digits(squeeze(value))
    epoch = (
        F.when(text.rlike(r"^\d{10}$"), F.expr("1000000L"))
        .when(text.rlike(r"^\d{13}$"), F.expr("1000L"))
        .when(text.rlike(r"^\d{16}$"), F.expr("1L"))
    )
    rewritten = F.lit(None).cast("string")
    for n in reversed(CASCADE):
        rewritten = F.when(text.rlike(n.pattern), F.regexp_replace(text, n.pattern, n.fields)).otherwise(rewritten)
    # Each step is a field of a struct held in a one-element array, so that it is computed once.
    part = lambda x, i: F.get(x, F.lit(i))
    number = lambda x, i: part(x, i).try_cast("int")

    def month(col: Column) -> Column:
        return F.coalesce(col.try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(col)).cast("int"), F.lit(0)))

    def fields(x: Column) -> Column:
        day_first = (part(x, 0) == "dmy") | ((part(x, 0) == "slash") & (date_order == "dmy"))
        month_first = (part(x, 0) == "mdy") | ((part(x, 0) == "slash") & (date_order == "mdy"))
        mon = F.when(day_first, month(part(x, 2))).when(month_first, month(part(x, 1)))
        day = F.when(day_first, number(x, 1)).when(month_first, number(x, 2))
        date = F.concat(part(x, 3), F.lit("-"), F.lpad(mon.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")
        has_clock, meridian = part(x, 4) != "", F.upper(part(x, 8))
        hour = number(x, 4)
        hour24 = F.when(meridian == "", hour).when(hour.between(1, 12), hour % 12 + F.when(meridian == "PM", 12).otherwise(0))
        minute, second = number(x, 5), F.coalesce(number(x, 6), F.lit(0))
        clock = F.when(hour24.between(0, 23) & minute.between(0, 59) & second.between(0, 59), (hour24 * 3600 + minute * 60 + second).cast("bigint") * 1_000_000)
        fraction = F.rpad(F.substring(part(x, 7), 1, 6), 6, "0").try_cast("bigint")
        return F.struct(
            (F.unix_date(date).cast("bigint") * DAY_US + F.when(has_clock, clock + fraction).otherwise(F.lit(0).cast("bigint"))).alias("local"),
            part(x, 9).alias("zone"),
        )

    offsets = F.create_map(*[F.lit(y) for k, v in ABBREVIATIONS.items() for y in (k, v)])
    zones = sorted(z for z in available_timezones() if "/" in z) + ["UTC"]

    def instant(f: Column) -> Column:
        z = f["zone"]
        signed = F.when(z.rlike(r"^[+-]"), F.when(z.startswith("-"), -1).otherwise(1) * (
            F.substring(z, 2, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(z, r"^[+-]\d{2}:?(\d{2})", 1).try_cast("int"), F.lit(0))
        ))
        fixed = F.coalesce(signed, F.try_element_at(offsets, F.upper(z)))
        named = F.when(z == "", zone).when(z.contains("/"), z)
        known = F.when(named.isin(zones), named)
        return F.when(fixed.isNotNull(), f["local"] - fixed.cast("bigint") * 60_000_000).when(
            known.isNotNull(), local_to_utc(f["local"], known, ambiguous, nonexistent)
        )

    split = F.split(rewritten, r"\|", -1)
    steps = F.transform(F.transform(F.array(split), fields), instant)
    return F.when(epoch.isNotNull(), F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")) * epoch).when(rewritten.isNotNull(), F.get(steps, F.lit(0)))


def notation(value: Column) -> Column:
    """The name of the first notation of the cascade that matches; `epoch`, `unreadable`, or null for blank."""
    text = fold_digits(squeeze(value))
    named = F.when(text.rlike(r"^(\d{10}|\d{13}|\d{16})$"), "epoch")
    for n in CASCADE:
        named = named.when(text.rlike(n.pattern), n.name)
    return F.when(text != "", named.otherwise("unreadable"))
