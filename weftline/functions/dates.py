"""Dates as text: layouts written by example, parsing, zones and calendar arithmetic that rolls over."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layout names and the layouts tried in turn, written as the reference time 2006-01-02 15:04:05 -0700 MST.
RFC3339, RFC1123, RFC822, RFC850, UNIX = "2006-01-02T15:04:05Z07:00", "Mon, 02 Jan 2006 15:04:05 MST", "02 Jan 06 15:04 MST", "Monday, 02-Jan-06 15:04:05 MST", "Mon Jan _2 15:04:05 MST 2006"
ALIASES = {"iso8601": RFC3339, "rfc3339": RFC3339, "rfc822": RFC822, "rfc850": RFC850, "rfc1123": RFC1123, "unix": UNIX, "date": "2006-01-02", "datetime": "2006-01-02 15:04:05", "time": "15:04:05", "timestamp": RFC3339}
#: Parts of a layout and the pattern letters they stand for.
PARTS = {
    "2006": "yyyy", "06": "yy", "January": "MMMM", "Jan": "MMM", "01": "MM", "1": "M", "Monday": "EEEE", "Mon": "EEE", "02": "dd", "_2": "d", "2": "d",
    "15": "HH", "03": "hh", "3": "h", "04": "mm", "4": "m", "05": "ss", "5": "s", "PM": "a", "Z07:00": "XXX", "-07:00": "xxx", "-0700": "xx", "MST": "z",
}
_TOKEN = re.compile(r"\.(0+|9+)|" + "|".join(sorted(map(re.escape, PARTS), key=len, reverse=True)))


def pattern(layout: str) -> str:
    """The date-time pattern of a layout or layout name."""
    layout, out, at = ALIASES.get(layout, layout), [], 0
    for m in _TOKEN.finditer(layout):
        if m.start() > at:
            out.append("'" + layout[at : m.start()].replace("'", "''") + "'" if re.search("[A-Za-z']", layout[at : m.start()]) else layout[at : m.start()])
        out.append(("." + "S" * len(m[1])) if m[1] else PARTS[m[0]])
        at = m.end()
    tail = layout[at:]
    return "".join(out) + ("'" + tail.replace("'", "''") + "'" if re.search("[A-Za-z']", tail) else tail)


def parse(c: Column, layout: str | None = None, short: bool = False) -> Column:
    """A timestamp (null if it cannot be read), by the layout or by the usual layouts in turn. The session zone is UTC."""
    if layout:
        return _by_pattern(c, pattern(layout))
    # RFC 3339 with any fraction, with and without a zone, and plain dates: one regular shape, read by the cast.
    iso = F.when(c.rlike(r"^\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)| \d\d:\d\d:\d\d(\.\d+)?)?$"), c.try_cast("timestamp"))
    if short:
        return iso
    named = [_by_pattern(c, pattern(x)) for x in (RFC1123, RFC822)]
    return F.coalesce(iso, *named)


def _by_pattern(c: Column, p: str) -> Column:
    """Reads by a pattern; a weekday at the beginning, which parsers refuse, is taken off both."""
    m = re.match(r"E+('[^']*'|[^A-Za-z'])*", p)
    if m:
        return F.try_to_timestamp(F.regexp_replace(c, r"^\p{L}+[^\p{L}\d]*", ""), F.lit(p[m.end() :]))
    return F.try_to_timestamp(c, F.lit(p))


def offset_of(c: Column) -> Column:
    """The zone offset a text carries ("Z" or ±hh:mm), "Z" if none."""
    found = F.regexp_extract(c, r"(Z|[+-]\d\d:\d\d)$", 1)
    return F.when(found == "", F.lit("Z")).otherwise(found)


def show(ts: Column, layout: str | None, zone: str | None, source: Column | None = None) -> Column:
    """Text of a timestamp by layout (RFC 3339 by default). Without ``zone`` a text keeps the offset it came with."""
    p = pattern(layout or RFC3339)
    if zone:
        local = F.from_utc_timestamp(ts, zone)
        if re.search("[XxzZ]", re.sub("'[^']*'", "", p)):
            minutes = ((F.unix_micros(local) - F.unix_micros(ts)) / 60_000_000).cast("int")
            return _with_offset(local, p, minutes)
        return F.date_format(local, p)
    if source is None or not re.search("[XxzZ]", re.sub("'[^']*'", "", p)):
        return F.date_format(ts if source is None else _shift(ts, _minutes(offset_of(source))), p)
    minutes = _minutes(offset_of(source))
    return _with_offset(_shift(ts, minutes), p, minutes)


def _minutes(offset: Column) -> Column:
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    return F.when(offset == "Z", F.lit(0)).otherwise(sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int")))


def _shift(ts: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + minutes.cast("long") * 60_000_000)


def _with_offset(local: Column, p: str, minutes: Column) -> Column:
    head, letters, tail = re.match(r"^(.*?)(X+|x+|z+|Z+)(.*)$", p).groups()
    digits = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"), F.lit(":" if len(letters) == 3 else ""), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    zone = F.when((minutes == 0) & F.lit(letters[0] in "Xz"), F.lit("Z" if letters[0] == "X" else "UTC")).otherwise(digits)
    parts = [F.date_format(local, head)] if head else []
    return F.concat(*parts, zone, *([F.date_format(local, tail)] if tail else []))


def add(ts: Column, years: int = 0, months: int = 0, days: int = 0, hours: float = 0, minutes: float = 0, seconds: float = 0) -> Column:
    """Calendar addition whose overflow rolls over (31 January + 1 month = 2 or 3 March), then a duration."""
    month = F.year(ts) * 12 + F.month(ts) - 1 + years * 12 + months
    day = F.date_add(F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1)), F.dayofmonth(ts) - 1 + days)
    clock = F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + clock + int((hours * 3600 + minutes * 60 + seconds) * 1_000_000))
