"""Dates, times and durations.

A date is a Spark date, a local datetime ``timestamp_ntz`` and a datetime ``timestamp`` (an
instant, shown in UTC); both hold microseconds, finer digits are cut off.  A local time is
nanoseconds of the day, a time the same with its offset in seconds.  A duration is four
whole numbers (months, days, seconds, nanos) that are compared part by part.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from fractions import Fraction
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError, NotSupported
from ..plans.types import DATE, DATETIME, DURATION, FLOAT, INT, LOCALDATETIME, LOCALTIME, NUMBER, STR, TIME, T, Typed
from . import scalar

#: Seconds of an average month and of a day.
MONTH_SECONDS, DAY_SECONDS, NANOS = 2_629_746, 86_400, 1_000_000_000

#: Arguments whose text is longer than this are evaluated once and then referred to by name.
LARGE = 300


def bind(build: Callable[..., Typed], *args: Typed) -> Typed:
    """``build(*args)``, where nested calls add to the expression instead of multiplying it.

    What is built here reads an argument many times.  A large one is put into an array of one
    row, over which ``transform`` runs the rest.
    """
    if not any(a.value is None and len(str(a.col)) > LARGE for a in args):
        return build(*args)
    made: list[Typed] = []

    def body(row: Column) -> Column:
        made.append(build(*[a if a.value is not None else Typed(row[f"v{i}"], a.t) for i, a in enumerate(args)]))
        return made[-1].col

    row = F.struct(*[a.col.alias(f"v{i}") for i, a in enumerate(args) if a.value is None])
    return Typed(F.transform(F.array(row), body)[0], made[-1].t)


def function(names: str, low: int = 1, high: int | None = None):
    """As ``scalar.function``, with arguments bound."""

    def keep(build):
        scalar.function(names, low, high)(partial(bind, build))
        return build

    return keep


def _constant(months: int, days: int, seconds: int, nanos: int) -> Typed:
    """A duration known while planning; what is computed from it stays a literal."""
    seconds, nanos = seconds + nanos // NANOS, nanos % NANOS
    value = (months, days, seconds, nanos)
    cols = [F.lit(v).cast("bigint").alias(n) for v, n in zip(value, ("months", "days", "seconds", "nanos"), strict=True)]
    return Typed(F.struct(*cols), DURATION, value)


def duration_of(months, days, seconds, nanos) -> Typed:
    if all(isinstance(x, int) for x in (months, days, seconds, nanos)):
        return _constant(months, days, seconds, nanos)
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (months, days, seconds, nanos)]
    carry = F.floor(parts[3].cast("bigint") / F.lit(NANOS)).cast("bigint")
    cols = [parts[0].cast("bigint"), parts[1].cast("bigint"), parts[2].cast("bigint") + carry, parts[3].cast("bigint") - carry * NANOS]
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    return Typed(F.when(known, F.struct(*[c.alias(n) for c, n in zip(cols, ("months", "days", "seconds", "nanos"), strict=True)])), DURATION)


def _part(x: Typed, *names: str) -> Typed | None:
    for n in names:
        if (t := x.t.field(n)) is not None:
            return Typed(x.col[n], t)
    return None


def _int(x: Typed | None, otherwise) -> Column:
    return F.lit(otherwise) if x is None else x.col.cast("int")


# --- constructors -----------------------------------------------------------------------


def _date_from_map(x: Typed) -> Column:
    base = _part(x, "date", "datetime", "localdatetime")
    day0 = as_date(base) if base else None
    year = _part(x, "year")
    y = year.col.cast("int") if year else F.year(day0) if base else None
    if week := _part(x, "week"):
        wy = year.col.cast("int") if year else F.extract(F.lit("YEAROFWEEK"), day0)
        jan4 = F.make_date(wy, F.lit(1), F.lit(4))
        monday = F.date_sub(jan4, F.weekday(jan4))
        dow = _part(x, "dayOfWeek")
        add = dow.col.cast("int") - 1 if dow else F.weekday(day0) if base else F.lit(0)
        return F.date_add(monday, ((week.col - 1) * 7 + add).cast("int"))
    if y is None:
        raise ArgumentError("a date needs a year")
    if quarter := _part(x, "quarter"):
        first = F.make_date(y, ((quarter.col - 1) * 3 + 1).cast("int"), F.lit(1))
        if day := _part(x, "dayOfQuarter"):
            return F.date_add(first, (day.col - 1).cast("int"))
        if base:
            month = ((quarter.col - 1) * 3 + (F.month(day0) - 1) % 3 + 1).cast("int")
            return F.make_date(y, month, _int(_part(x, "day"), 0) if _part(x, "day") else F.day(day0))
        return first
    if ordinal := _part(x, "ordinalDay"):
        return F.date_add(F.make_date(y, F.lit(1), F.lit(1)), (ordinal.col - 1).cast("int"))
    month, day = _part(x, "month"), _part(x, "day")
    m = month.col.cast("int") if month else F.month(day0) if base else F.lit(1)
    d = day.col.cast("int") if day else F.day(day0) if base else F.lit(1)
    return F.make_date(y, m, d)


def as_date(x: Typed) -> Column:
    return x.col if x.t.kind == "date" else F.to_date(x.col)


_DATE_TEXT = (
    (r"^(\d{4})-?(\d{2})-?(\d{2})$", lambda g: F.make_date(g(1), g(2), g(3))),
    (r"^(\d{4})-?W(\d{2})-?(\d)$", lambda g: _iso_week(g(1), g(2), g(3))),
    (r"^(\d{4})-?W(\d{2})$", lambda g: _iso_week(g(1), g(2), F.lit(1))),
    (r"^(\d{4})-Q(\d)-(\d{2})$", lambda g: F.date_add(F.make_date(g(1), (g(2) - 1) * 3 + 1, F.lit(1)), g(3) - 1)),
    (r"^(\d{4})-?(\d{3})$", lambda g: F.date_add(F.make_date(g(1), F.lit(1), F.lit(1)), g(2) - 1)),
    (r"^(\d{4})-?(\d{2})$", lambda g: F.make_date(g(1), g(2), F.lit(1))),
    (r"^(\d{4})$", lambda g: F.make_date(g(1), F.lit(1), F.lit(1))),
)


def date_text(text: str) -> datetime.date:
    """The date a constant text stands for."""
    form = re.fullmatch(r"(\d{4})(?:-?W(\d{2})(?:-?(\d))?|-Q(\d)-(\d{2})|-?(\d{2})-?(\d{2})|-?(\d{3})|-?(\d{2}))?", text)
    if not form:
        raise ArgumentError(f"no date: {text}")
    year, week, dow, quarter, doq, month, day, ordinal, only = (int(g) if g else None for g in form.groups())
    try:
        if week:
            return datetime.date.fromisocalendar(year, week, dow or 1)
        if quarter:
            return datetime.date(year, quarter * 3 - 2, 1) + datetime.timedelta(doq - 1)
        if ordinal:
            return datetime.date(year, 1, 1) + datetime.timedelta(ordinal - 1)
        return datetime.date(year, month or only or 1, day or 1)
    except ValueError as e:
        raise ArgumentError(f"no date: {text}: {e}") from None


def _iso_week(year: Column, week: Column, day: Column) -> Column:
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(jan4, F.weekday(jan4)), (week - 1) * 7 + day - 1)


def _date_from_text(s: Column) -> Column:
    out = None
    for pattern, build in _DATE_TEXT:
        value = build(lambda i, p=pattern: F.regexp_extract(s, p, i).try_cast("int"))
        test = F.rlike(s, F.lit(pattern))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.when(s.isNotNull(), F.raise_error(F.concat(F.lit("no date: "), s)).cast("date"))


_TIME_TEXT = r"^(\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:\.(\d{1,9}))?(Z|[+-]\d{2}(?::?\d{2})?)?(?:\[[^\]]*\])?$"


def _time_parts(s: Column) -> tuple[Column, Column]:
    """Nanoseconds of the day and offset in seconds (null if none is given)."""
    g = lambda i: F.coalesce(F.regexp_extract(s, _TIME_TEXT, i).try_cast("bigint"), F.lit(0).cast("bigint"))
    frac = F.rpad(F.regexp_extract(s, _TIME_TEXT, 4), 9, "0").try_cast("bigint")
    ns = (g(1) * 3600 + g(2) * 60 + g(3)) * NANOS + F.coalesce(frac, F.lit(0).cast("bigint"))
    z = F.regexp_extract(s, _TIME_TEXT, 5)
    digits = F.regexp_replace(z, "[:+-]", "")
    off = F.substr(digits, F.lit(1), F.lit(2)).try_cast("int") * 3600 + F.coalesce(F.substr(digits, F.lit(3), F.lit(2)).try_cast("int"), F.lit(0)) * 60
    offset = F.when(z == "Z", F.lit(0)).when(z == "", F.lit(None)).when(F.startswith(z, F.lit("-")), -off).otherwise(off)
    ok = F.when(F.rlike(s, F.lit(_TIME_TEXT)), ns).when(s.isNotNull(), F.raise_error(F.concat(F.lit("no time: "), s)).cast("bigint"))
    return ok, offset.cast("int")


def nanos_of(x: Typed) -> Column:
    """Nanoseconds of the day of anything with a time of day."""
    if x.t.kind == "localtime":
        return x.col
    if x.t.kind == "time":
        return x.col["nanos"]
    if x.t.kind == "date":
        return F.when(x.col.isNotNull(), F.lit(0).cast("bigint"))
    ts = x.col
    return (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * NANOS + (F.extract(F.lit("SECOND"), ts) * NANOS).cast("bigint")


def _nanos_from_map(x: Typed) -> Column:
    base = _part(x, "time", "datetime", "localdatetime", "localtime")
    whole = nanos_of(base) if base else F.lit(0).cast("bigint")
    sec = whole.cast("bigint")
    unit = lambda size, mod: F.floor(sec / F.lit(size)).cast("bigint") % mod
    h = _part(x, "hour")
    m, s = _part(x, "minute"), _part(x, "second")
    hour = h.col if h else unit(3600 * NANOS, 24)
    minute = m.col if m else unit(60 * NANOS, 60)
    second = s.col if s else unit(NANOS, 60)
    below = sec % NANOS  # each sub-second key overrides its own digits only
    milli, micro, nano = (_part(x, n) for n in ("millisecond", "microsecond", "nanosecond"))
    a = milli.col if milli else F.floor(below / F.lit(1_000_000)).cast("bigint")
    b = micro.col if micro else F.floor(below / F.lit(1000)).cast("bigint") % 1000
    c = nano.col if nano else below % 1000
    sub = a * 1_000_000 + b * 1000 + c
    return ((hour * 3600 + minute * 60 + second) * NANOS + sub).cast("bigint")


def _offset(x: Typed | None) -> Column:
    """Seconds of a fixed offset given as text."""
    if x is None:
        return F.lit(0)
    s = x.col
    digits = F.regexp_replace(s, "[:+-]", "")
    off = F.substr(digits, F.lit(1), F.lit(2)).try_cast("int") * 3600 + F.coalesce(F.substr(digits, F.lit(3), F.lit(2)).try_cast("int"), F.lit(0)) * 60
    return F.when(s.isin("Z", "UTC"), F.lit(0)).when(F.startswith(s, F.lit("-")), -off).otherwise(off).cast("int")


def stamp(day: Column, nanos: Column) -> Column:
    """A local datetime from a date and nanoseconds of the day."""
    return F.timestamp_add("MICROSECOND", F.floor(nanos / F.lit(1000)).cast("bigint"), day.cast("timestamp_ntz"))


@function("date date.realtime date.statement date.transaction", 0, 1)
def _date(x: Typed | None = None) -> Typed:
    if x is None:
        return Typed(F.current_date(), DATE)
    if x.t.kind == "null":
        return Typed(F.lit(None).cast("date"), DATE)
    if x.t.kind == "str":
        known = date_text(x.value) if isinstance(x.value, str) else None
        return Typed(F.lit(known), DATE, known) if known else Typed(_date_from_text(x.col), DATE)
    if x.t.kind == "map":
        return Typed(_date_from_map(x), DATE)
    return Typed(as_date(x), DATE)


@function("localtime localtime.realtime localtime.statement localtime.transaction", 0, 1)
def _localtime(x: Typed | None = None) -> Typed:
    if x is None:
        return Typed(nanos_of(Typed(F.localtimestamp(), LOCALDATETIME)), LOCALTIME)
    if x.t.kind == "null":
        return Typed(F.lit(None).cast("bigint"), LOCALTIME)
    if x.t.kind == "str":
        return Typed(_time_parts(x.col)[0], LOCALTIME)
    return Typed(_nanos_from_map(x) if x.t.kind == "map" else nanos_of(x), LOCALTIME)


@function("time time.realtime time.statement time.transaction", 0, 1)
def _time(x: Typed | None = None) -> Typed:
    if x is None:
        x = Typed(F.localtimestamp(), LOCALDATETIME)
    if x.t.kind == "null":
        return Typed(F.lit(None).cast("struct<nanos:bigint,off:int>"), TIME)
    if x.t.kind == "str":
        ns, off = _time_parts(x.col)
        off = F.coalesce(off, F.lit(0))
    elif x.t.kind == "map":
        ns, off = _nanos_from_map(x), _offset(_part(x, "timezone"))
    elif x.t.kind == "time":
        return x
    else:
        ns, off = nanos_of(x), F.lit(0)
    return Typed(F.when(ns.isNotNull(), F.struct(ns.alias("nanos"), off.cast("int").alias("off"))), TIME)


def _split_stamp(s: Column) -> tuple[Column, Column, Column]:
    parts = F.split(s, "T", 2)
    t = F.when(F.size(parts) > 1, parts[1]).otherwise(F.lit("00:00"))
    ns, off = _time_parts(t)
    return _date_from_text(parts[0]), ns, off


@function("localdatetime localdatetime.realtime localdatetime.statement localdatetime.transaction", 0, 1)
def _localdatetime(x: Typed | None = None) -> Typed:
    if x is None:
        return Typed(F.localtimestamp(), LOCALDATETIME)
    if x.t.kind == "null":
        return Typed(F.lit(None).cast("timestamp_ntz"), LOCALDATETIME)
    if x.t.kind == "str":
        d, ns, _ = _split_stamp(x.col)
        return Typed(stamp(d, ns), LOCALDATETIME)
    if x.t.kind == "map":
        return Typed(stamp(_date_from_map(x), _nanos_from_map(x)), LOCALDATETIME)
    return Typed(x.col.cast("timestamp_ntz"), LOCALDATETIME)


@function("datetime datetime.realtime datetime.statement datetime.transaction", 0, 1)
def _datetime(x: Typed | None = None) -> Typed:
    if x is None:
        return Typed(F.current_timestamp(), DATETIME)
    if x.t.kind == "null":
        return Typed(F.lit(None).cast("timestamp"), DATETIME)
    if x.t.kind == "str":
        d, ns, off = _split_stamp(x.col)
        zone = F.regexp_extract(x.col, r"\[([^\]]+)\]", 1)
        local = stamp(d, ns)
        named = F.convert_timezone(F.when(zone == "", F.lit("UTC")).otherwise(zone), F.lit("UTC"), local)
        moved = F.when(off.isNull() & (zone != ""), named).otherwise(F.timestamp_add("SECOND", -F.coalesce(off, F.lit(0)), local))
        return Typed(moved.cast("timestamp"), DATETIME)
    if x.t.kind == "map":
        if e := _part(x, "epochSeconds"):
            return Typed(F.timestamp_seconds(e.col), DATETIME)
        if e := _part(x, "epochMillis"):
            return Typed(F.timestamp_millis(e.col), DATETIME)
        zone, local = _part(x, "timezone"), stamp(_date_from_map(x), _nanos_from_map(x))
        moved = F.timestamp_add("SECOND", -_offset(zone), local)
        if zone is not None:
            named = F.when(_offset(zone).isNull(), zone.col)
            moved = F.when(named.isNotNull(), F.convert_timezone(named, F.lit("UTC"), local)).otherwise(moved)
        return Typed(moved.cast("timestamp"), DATETIME)
    return Typed(x.col.cast("timestamp"), DATETIME)


@function("datetime.fromepoch", 2)
def _from_epoch(s: Typed, n: Typed) -> Typed:
    return Typed(F.timestamp_micros((s.col * 1_000_000 + F.floor(n.col / F.lit(1000))).cast("bigint")), DATETIME)


@function("datetime.fromepochmillis", 1)
def _from_millis(ms: Typed) -> Typed:
    return Typed(F.timestamp_millis(ms.col), DATETIME)


# --- durations --------------------------------------------------------------------------

_UNITS = (("years", 12, 0, 0, 0), ("quarters", 3, 0, 0, 0), ("months", 1, 0, 0, 0), ("weeks", 0, 7, 0, 0), ("days", 0, 1, 0, 0), ("hours", 0, 0, 3600, 0), ("minutes", 0, 0, 60, 0), ("seconds", 0, 0, 1, 0), ("milliseconds", 0, 0, 0, 1_000_000), ("microseconds", 0, 0, 0, 1000), ("nanoseconds", 0, 0, 0, 1))
_DURATION_TEXT = re.compile(r"^([+-]?)P(?:([+-]?[\d.]+)Y)?(?:([+-]?[\d.]+)M)?(?:([+-]?[\d.]+)W)?(?:([+-]?[\d.]+)D)?(?:T(?:([+-]?[\d.]+)H)?(?:([+-]?[\d.]+)M)?(?:([+-]?[\d.]+)S)?)?$")


def _cascade(months: Fraction, days: Fraction, seconds: Fraction) -> tuple[int, int, int, int]:
    """Fractions of a unit go down to the next, by the average month and the day of 86,400 s."""
    m = int(months)
    seconds += (months - m) * MONTH_SECONDS
    carried = int(seconds / DAY_SECONDS) if months != m else 0
    days += carried
    seconds -= carried * DAY_SECONDS
    d = int(days)
    seconds += (days - d) * DAY_SECONDS
    s = seconds.__floor__()
    return m, d, s, int((seconds - s) * NANOS)


def duration_text(text: str) -> tuple[int, int, int, int]:
    m = _DURATION_TEXT.match(text)
    if not m or text.rstrip("T").lstrip("+-") == "P":
        raise ArgumentError(f"no duration: {text}")
    y, mo, w, d, h, mi, s = (Fraction(g) if g else Fraction(0) for g in m.groups()[1:])
    sign = -1 if m[1] == "-" else 1
    return _cascade(sign * (12 * y + mo), sign * (7 * w + d), sign * (3600 * h + 60 * mi + s))


@function("duration")
def _duration(x: Typed) -> Typed:
    if x.t.kind == "null":
        return Typed(F.lit(None).cast("struct<months:bigint,days:bigint,seconds:bigint,nanos:bigint>"), DURATION)
    if x.t.kind == "duration":
        return x
    if x.t.kind == "str":
        if isinstance(x.value, str):
            return duration_of(*duration_text(x.value))
        g = lambda i: F.coalesce(F.regexp_extract(x.col, r"^P(?:(-?\d+)Y)?(?:(-?\d+)M)?(?:(-?\d+)W)?(?:(-?\d+)D)?(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?\d+)S)?)?$", i).try_cast("bigint"), F.lit(0).cast("bigint"))
        return duration_of(g(1) * 12 + g(2), g(3) * 7 + g(4), g(5) * 3600 + g(6) * 60 + g(7), F.lit(0))
    if x.t.kind != "map":
        raise ArgumentError(f"no duration from {x.t}")
    unknown = {n for n, _ in x.t.fields} - {u[0] for u in _UNITS}
    if unknown:
        raise ArgumentError(f"no units of a duration: {sorted(unknown)}")
    if isinstance(x.value, dict):
        given = {k: Fraction(str(v)) for k, v in x.value.items()}
        m, d, sec, n = (sum((given[u] * s[i] for u, *s in _UNITS if u in given), Fraction(0)) for i in range(4))
        whole = all(v.denominator == 1 for v in given.values())
        return duration_of(int(m), int(d), int(sec), int(n)) if whole else duration_of(*_cascade(m, d, sec + n / NANOS))
    if all(t.kind in ("int", "null") for _, t in x.t.fields):
        total = [F.lit(0).cast("bigint") for _ in range(4)]
        for name, *sizes in _UNITS:
            if (p := _part(x, name)) is not None:
                total = [a + p.col * s if s else a for a, s in zip(total, sizes, strict=True)]
        return duration_of(*total)
    # Fractions: months keep their whole part, the rest goes down in seconds.
    months = days = seconds = F.lit(0.0)
    for name, m, d, s, n in _UNITS:
        if (p := _part(x, name)) is not None:
            v = p.col.cast("double")
            months, days, seconds = months + v * m, days + v * d, seconds + v * (s + n / NANOS)
    whole = F.when(months < 0, F.ceil(months)).otherwise(F.floor(months))
    spare = (months - whole) * MONTH_SECONDS
    lent = F.when(spare < 0, F.ceil(spare / DAY_SECONDS)).otherwise(F.floor(spare / DAY_SECONDS))
    days, spare = days + lent, spare - lent * DAY_SECONDS
    d = F.when(days < 0, F.ceil(days)).otherwise(F.floor(days))
    nanos = F.round((seconds + spare + (days - d) * DAY_SECONDS) * NANOS).cast("bigint")
    return duration_of(whole, d, F.lit(0), nanos)


_DATED = ("date", "datetime", "localdatetime")


def _micros(x: Typed) -> Column:
    """Microseconds since the epoch, or of the day where there is no date."""
    if x.t.kind in ("time", "localtime"):
        return F.floor(nanos_of(x) / F.lit(1000)).cast("bigint")
    if x.t.kind == "date":
        return F.unix_date(x.col).cast("bigint") * (DAY_SECONDS * 1_000_000)
    return F.unix_micros(x.col.cast("timestamp"))


def _of_micros(us: Column) -> Typed:
    s = F.floor(us / F.lit(1_000_000)).cast("bigint")
    return duration_of(F.lit(0), F.lit(0), s, (us - s * 1_000_000) * 1000)


def _months_between(a: Typed, b: Typed) -> tuple[Column, Column]:
    """Whole months from ``a`` to ``b`` (toward zero), and the microseconds that are left."""
    la, lb = (as_date(x).cast("timestamp_ntz") if x.t.kind == "date" else x.col.cast("timestamp_ntz") for x in (a, b))
    raw = (F.year(lb) - F.year(la)) * 12 + F.month(lb) - F.month(la)
    rest = lambda x: F.day(x).cast("bigint") * DAY_SECONDS * 1_000_000 + (F.hour(x) * 3600 + F.minute(x) * 60).cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("bigint")
    diff = rest(lb) - rest(la)
    months = F.when((raw > 0) & (diff < 0), raw - 1).when((raw < 0) & (diff > 0), raw + 1).otherwise(raw)
    moved = F.timestamp_add("MONTH", months.cast("int"), la)
    return months, F.unix_micros(lb.cast("timestamp")) - F.unix_micros(moved.cast("timestamp"))


def _toward_zero(x: Column, by: int) -> Column:
    q = x / F.lit(by)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("bigint")


@function("duration.between", 2)
def _between(a: Typed, b: Typed) -> Typed:
    if a.t.kind not in _DATED or b.t.kind not in _DATED:
        return _in_seconds(a, b)
    months, us = _months_between(a, b)
    days = _toward_zero(us, DAY_SECONDS * 1_000_000)
    left = us - days * (DAY_SECONDS * 1_000_000)
    s = F.floor(left / F.lit(1_000_000)).cast("bigint")
    return duration_of(months, days, s, (left - s * 1_000_000) * 1000)


@function("duration.inmonths", 2)
def _in_months(a: Typed, b: Typed) -> Typed:
    if a.t.kind not in _DATED or b.t.kind not in _DATED:
        return duration_of(0, 0, 0, 0)
    return duration_of(_months_between(a, b)[0], F.lit(0), F.lit(0), F.lit(0))


def _difference(a: Typed, b: Typed) -> Column:
    if (a.t.kind in _DATED) != (b.t.kind in _DATED):
        return F.floor((nanos_of(b) - nanos_of(a)) / F.lit(1000)).cast("bigint")
    out = _micros(b) - _micros(a)
    if a.t.kind == b.t.kind == "time":
        out = out - (b.col["off"] - a.col["off"]).cast("bigint") * 1_000_000
    return out


@function("duration.indays", 2)
def _in_days(a: Typed, b: Typed) -> Typed:
    if a.t.kind not in _DATED or b.t.kind not in _DATED:
        return duration_of(0, 0, 0, 0)
    return duration_of(F.lit(0), _toward_zero(_difference(a, b), DAY_SECONDS * 1_000_000), F.lit(0), F.lit(0))


@function("duration.inseconds", 2)
def _in_seconds(a: Typed, b: Typed) -> Typed:
    return _of_micros(_difference(a, b))


# --- arithmetic -------------------------------------------------------------------------


def _shift(x: Typed, d: Column, sign: int) -> Typed:
    months, days, seconds, nanos = (d[n] * sign for n in ("months", "days", "seconds", "nanos"))
    if x.t.kind == "date":
        extra = _toward_zero(seconds, DAY_SECONDS)
        return Typed(F.date_add(F.add_months(x.col, months.cast("int")), (days + extra).cast("int")), DATE)
    if x.t.kind in ("datetime", "localdatetime"):
        moved = F.timestamp_add("DAY", days.cast("int"), F.timestamp_add("MONTH", months.cast("int"), x.col))
        return Typed(F.timestamp_add("MICROSECOND", seconds * 1_000_000 + F.floor(nanos / F.lit(1000)).cast("bigint"), moved), x.t)
    day = F.lit(DAY_SECONDS * NANOS)
    ns = F.pmod(nanos_of(x) + (seconds % DAY_SECONDS) * NANOS + nanos, day)
    return Typed(ns, LOCALTIME) if x.t.kind == "localtime" else Typed(F.struct(ns.alias("nanos"), x.col["off"].alias("off")), TIME)


def temporal_arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    return bind(partial(_arithmetic, op), a, b)


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    names = ("months", "days", "seconds", "nanos")
    ka, kb = a.t.kind, b.t.kind
    if isinstance(a.value, tuple) and ka == "duration":  # constants stay constants
        if isinstance(b.value, tuple) and kb == "duration" and op in "+-":
            return duration_of(*[x + y if op == "+" else x - y for x, y in zip(a.value, b.value, strict=True)])
        if isinstance(b.value, int) and kb == "int" and op == "*":
            return duration_of(*[x * b.value for x in a.value])
    if ka == kb == "duration" and op in "+-":
        sign = 1 if op == "+" else -1
        return duration_of(*[a.col[n] + b.col[n] * sign for n in names])
    if kb == "duration" and op in "+-" and ka in ("date", "datetime", "localdatetime", "time", "localtime"):
        return _shift(a, b.col, 1 if op == "+" else -1)
    if ka == "duration" and op == "+" and kb not in NUMBER:
        return _shift(b, a.col, 1)
    if op == "*" and ka in NUMBER and kb == "duration":
        a, b, ka, kb = b, a, kb, ka
    if ka == "duration" and kb == "int" and op == "*":
        return duration_of(*[a.col[n] * b.col for n in names])
    if ka == "duration" and kb in NUMBER and op in "*/":
        by = b.col.cast("double") if op == "*" else F.lit(1.0) / b.col.cast("double")
        months = a.col["months"] * by
        whole = F.when(months < 0, F.ceil(months)).otherwise(F.floor(months))
        spare = (months - whole) * MONTH_SECONDS
        lent = F.when(spare < 0, F.ceil(spare / DAY_SECONDS)).otherwise(F.floor(spare / DAY_SECONDS))
        days = a.col["days"] * by + lent
        d = F.when(days < 0, F.ceil(days)).otherwise(F.floor(days))
        s = a.col["seconds"] * by + (days - d) * DAY_SECONDS + spare - lent * DAY_SECONDS
        return duration_of(whole, d, F.lit(0), F.round(s * NANOS + a.col["nanos"] * by).cast("bigint"))
    raise ArgumentError(f"cannot apply {op} to {a.t} and {b.t}")


# --- components, truncation, text ---------------------------------------------------------


def component(x: Typed, name: str) -> Typed:
    """``value.year`` and the like; an unknown name is null."""
    return bind(partial(_component, name), x)


def _component(name: str, x: Typed) -> Typed:
    k, c = x.t.kind, x.col
    if k == "duration":
        whole = {"years": _toward_zero(c["months"], 12), "quarters": _toward_zero(c["months"], 3), "months": c["months"], "weeks": _toward_zero(c["days"], 7), "days": c["days"], "hours": _toward_zero(c["seconds"], 3600), "minutes": _toward_zero(c["seconds"], 60), "seconds": c["seconds"], "milliseconds": c["seconds"] * 1000 + _toward_zero(c["nanos"], 1_000_000), "microseconds": c["seconds"] * 1_000_000 + _toward_zero(c["nanos"], 1000), "nanoseconds": c["seconds"] * NANOS + c["nanos"], "monthsOfYear": c["months"] % 12, "quartersOfYear": _toward_zero(c["months"], 3) % 4, "monthsOfQuarter": c["months"] % 3, "daysOfWeek": c["days"] % 7, "minutesOfHour": _toward_zero(c["seconds"], 60) % 60, "secondsOfMinute": c["seconds"] % 60, "nanosecondsOfSecond": c["nanos"], "millisecondsOfSecond": _toward_zero(c["nanos"], 1_000_000), "microsecondsOfSecond": _toward_zero(c["nanos"], 1000)}
        return Typed(whole[name].cast("bigint"), INT) if name in whole else Typed(F.lit(None).cast("bigint"), INT)
    out = None
    if k in _DATED:
        first = F.trunc(as_date(x), "quarter")
        out = {"year": lambda: F.year(c), "quarter": lambda: F.quarter(c), "month": lambda: F.month(c), "week": lambda: F.weekofyear(c), "weekYear": lambda: F.extract(F.lit("YEAROFWEEK"), c), "day": lambda: F.day(c), "ordinalDay": lambda: F.dayofyear(c), "dayOfWeek": lambda: F.weekday(c) + 1, "weekDay": lambda: F.weekday(c) + 1, "dayOfQuarter": lambda: F.datediff(as_date(x), first) + 1}.get(name)
    if out is None and k != "date":
        ns = nanos_of(x)
        out = {"hour": lambda: _toward_zero(ns, 3600 * NANOS), "minute": lambda: _toward_zero(ns, 60 * NANOS) % 60, "second": lambda: _toward_zero(ns, NANOS) % 60, "millisecond": lambda: _toward_zero(ns % NANOS, 1_000_000), "microsecond": lambda: _toward_zero(ns % NANOS, 1000), "nanosecond": lambda: ns % NANOS}.get(name)
    if out is None and k == "datetime":
        if name in ("timezone", "offset"):
            return Typed(F.when(c.isNotNull(), F.lit("Z")), STR)
        out = {"epochMillis": lambda: F.unix_millis(c), "epochSeconds": lambda: F.unix_seconds(c), "offsetMinutes": lambda: F.lit(0), "offsetSeconds": lambda: F.lit(0)}.get(name)
    if out is None and k == "time" and name in ("offsetSeconds", "offsetMinutes"):
        out = {"offsetSeconds": lambda: c["off"], "offsetMinutes": lambda: _toward_zero(c["off"], 60)}[name]
    if out is None and k == "time" and name in ("offset", "timezone"):
        return Typed(_offset_text(c["off"]), STR)
    return Typed(out().cast("bigint"), INT) if out else Typed(F.lit(None).cast("bigint"), INT)


def _offset_text(off: Column) -> Column:
    a = F.abs(off)
    return F.when(off == 0, F.lit("Z")).otherwise(F.format_string("%s%02d:%02d", F.when(off < 0, F.lit("-")).otherwise(F.lit("+")), F.floor(a / 3600).cast("int"), (F.floor(a / 60) % 60).cast("int")))


def _truncate_date(unit: str, d: Column) -> Column:
    year = F.year(d)
    if unit in ("millennium", "century", "decade"):
        n = {"millennium": 1000, "century": 100, "decade": 10}[unit]
        return F.make_date((year - F.pmod(year, F.lit(n))).cast("int"), F.lit(1), F.lit(1))
    if unit == "weekyear":
        return _iso_week(F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.lit(1), F.lit(1))
    if unit in ("year", "quarter", "month", "week"):
        return F.trunc(d, unit)
    if unit in ("day", "hour", "minute", "second", "millisecond", "microsecond"):
        return d
    raise ArgumentError(f"no unit to cut at: {unit}")


_CUTS = {"hour": 3600 * NANOS, "minute": 60 * NANOS, "second": NANOS, "millisecond": 1_000_000, "microsecond": 1000}


def _truncate(kind: str):
    def build(unit: Typed, x: Typed | None = None, over: Typed | None = None) -> Typed:
        if not isinstance(unit.value, str):
            raise ArgumentError("truncate needs a constant unit")
        u = unit.value.lower()
        if x is None:
            x = Typed(F.localtimestamp(), LOCALDATETIME)
        fields = dict(over.t.fields or ()) if over is not None and over.t.kind == "map" else {}
        day = _truncate_date(u, as_date(x)) if x.t.kind in _DATED else None
        ns = nanos_of(x)
        ns = ns - ns % _CUTS[u] if u in _CUTS else F.lit(0).cast("bigint")
        if day is not None and any(n in fields for n in ("year", "month", "day", "dayOfWeek", "ordinalDay", "quarter", "dayOfQuarter", "week")):
            if "dayOfWeek" in fields:
                day = F.date_add(F.date_sub(day, F.weekday(day)), (over.col["dayOfWeek"] - 1).cast("int"))
            names = [(n, t) for n, t in fields.items() if n not in ("dayOfWeek", "hour", "minute", "second", "millisecond", "microsecond", "nanosecond", "timezone")]
            if names:
                m = F.struct(day.alias("date"), *[over.col[n].alias(n) for n, _ in names])
                day = _date_from_map(Typed(m, T("map", None, (("date", DATE), *names))))
        clock = [(n, t) for n, t in fields.items() if n in ("hour", "minute", "second", "millisecond", "microsecond", "nanosecond")]
        if clock:
            m = F.struct(ns.alias("localtime"), *[over.col[n].alias(n) for n, _ in clock])
            ns = _nanos_from_map(Typed(m, T("map", None, (("localtime", LOCALTIME), *clock))))
        if kind == "date":
            return Typed(day, DATE)
        if kind == "localtime":
            return Typed(ns, LOCALTIME)
        if kind == "time":
            off = x.col["off"] if x.t.kind == "time" else F.lit(0)
            return Typed(F.struct(ns.cast("bigint").alias("nanos"), off.cast("int").alias("off")), TIME)
        return Typed(stamp(day, ns) if kind == "localdatetime" else stamp(day, ns).cast("timestamp"), LOCALDATETIME if kind == "localdatetime" else DATETIME)

    return build


for _kind in ("date", "time", "localtime", "datetime", "localdatetime"):
    function(f"{_kind}.truncate", 1, 3)(_truncate(_kind))


def _clock_text(ns: Column) -> Column:
    base = F.format_string("%02d:%02d", _toward_zero(ns, 3600 * NANOS), _toward_zero(ns, 60 * NANOS) % 60)
    sec, sub = _toward_zero(ns, NANOS) % 60, ns % NANOS
    tail = F.when((sec == 0) & (sub == 0), F.lit("")).otherwise(F.format_string(":%02d", sec))
    frac = F.when(sub == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.regexp_replace(F.format_string("%09d", sub), "0+$", "")))
    return F.concat(base, tail, frac)


def duration_string(months: int, days: int, seconds: int, nanos: int) -> str:
    """ISO text of a duration; parts of zero are left out."""
    cut = lambda v, by: abs(v) // by * (1 if v >= 0 else -1)
    total = seconds * NANOS + nanos
    h = cut(total, 3600 * NANOS)
    mi = cut(total - h * 3600 * NANOS, 60 * NANOS)
    rest = total - h * 3600 * NANOS - mi * 60 * NANOS
    frac = f".{abs(rest) % NANOS:09d}".rstrip("0") if rest % NANOS else ""
    sec = f"{'-' if rest < 0 else ''}{abs(rest) // NANOS}{frac}S" if rest else ""
    y = cut(months, 12)
    day = "".join(f"{v}{u}" for v, u in ((y, "Y"), (months - 12 * y, "M"), (days, "D")) if v)
    clock = "".join(f"{v}{u}" for v, u in ((h, "H"), (mi, "M")) if v) + sec
    return f"P{day}{'T' + clock if clock else ''}" if day or clock else "PT0S"


def to_text(x: Typed) -> Typed:
    k, c = x.t.kind, x.col
    if k == "localtime":
        return Typed(_clock_text(c), STR)
    if k == "time":
        return Typed(F.concat(_clock_text(c["nanos"]), _offset_text(c["off"])), STR)
    if k in ("localdatetime", "datetime"):
        s = F.concat(F.to_date(c).cast("string"), F.lit("T"), _clock_text(nanos_of(x)))
        return Typed(s if k == "localdatetime" else F.concat(s, F.lit("Z")), STR)
    if k == "duration" and isinstance(x.value, tuple):
        return Typed(F.lit(duration_string(*x.value)), STR)
    if k == "duration":
        y, m = _toward_zero(c["months"], 12), c["months"] % 12
        h, mi = _toward_zero(c["seconds"], 3600), _toward_zero(c["seconds"], 60) % 60
        s, n = c["seconds"] % 60, c["nanos"]
        part = lambda v, unit: F.when(v != 0, F.concat(v.cast("string"), F.lit(unit))).otherwise(F.lit(""))
        value = (s * NANOS + n).cast("bigint")
        a = F.abs(value)
        digits = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), _toward_zero(a, NANOS).cast("string"), F.when(a % NANOS != 0, F.concat(F.lit("."), F.regexp_replace(F.format_string("%09d", a % NANOS), "0+$", ""))).otherwise(F.lit("")), F.lit("S"))
        clock = F.concat(part(h, "H"), part(mi, "M"), F.when(value != 0, digits).otherwise(F.lit("")))
        days = F.concat(part(y, "Y"), part(m, "M"), part(c["days"], "D"))
        out = F.concat(F.lit("P"), days, F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(F.lit("")))
        return Typed(F.when((days == "") & (clock == ""), F.lit("PT0S")).otherwise(out), STR)
    raise NotSupported(f"a text of {x.t}")


__all__ = ["FLOAT", "component", "duration_text", "temporal_arithmetic", "to_text"]
