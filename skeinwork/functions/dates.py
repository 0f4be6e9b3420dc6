"""Dates and times: microseconds since 1970 in UTC, whatever the session's zone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import DATE, DATETIME, INT32, INT64, INTEGERS, STRING
from .core import Bound, Expr, evaluation_error, single, unary, want
from .elementary import parse_datetime
from .terminals import ConstDateTime as _ConstMicros
from .terminals import ConstInt64, from_micros, now_micros

_EPOCH = "1970-01-01 00:00:00"
_when = {DATETIME, DATE}


def micros(x: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), x)


def ConstDateTime(value: str | int) -> Expr:
    """From ``YYYY/MM/DD-HH:MM:SS`` (null if malformed), or microseconds."""
    if isinstance(value, int):
        return _ConstMicros(value)
    return single(lambda s: Bound("CONST_DATETIME", DATETIME, True, parse_datetime(F.lit(value), "yyyy/M/d-H:m:s")))


def ConstDateTimeFromMicrosecondsSinceEpoch(value: int) -> Expr:
    return _ConstMicros(value)


def ConstDateTimeFromSecondsSinceEpoch(value: float) -> Expr:
    return _ConstMicros(int(value * 1e6))


def Now() -> Expr:
    """The time at which the expression was made."""
    return _ConstMicros(now_micros())


UnixTimestamp = unary("UNIXTIMESTAMP", _when, INT64, lambda x: F.call_function("div", micros(x), F.lit(1_000_000).cast("bigint")), convert=DATETIME)


def _from_unix(x):
    checked = F.when(x >= 0, x).when(x < 0, evaluation_error("negative time", "bigint"))
    return from_micros(checked.cast("bigint") * 1_000_000)


FromUnixTime = unary("FROMUNIXTIME", INTEGERS, DATETIME, _from_unix)


def _date(y: Column, m: Column, d: Column) -> Column:
    """Months and days beyond their range roll over."""
    first = F.timestamp_add("MONTH", (y.cast("bigint") - 1970) * 12 + m.cast("bigint") - 1, F.lit(_EPOCH).cast("timestamp_ntz"))
    return F.timestamp_add("DAY", d.cast("bigint") - 1, first)


def _parts(s, what, parts):
    bound = [want(p.one(s), INTEGERS, what) for p in parts]
    return [b.col for b in bound], any(b.nullable for b in bound), f"{what}({', '.join(b.name for b in bound)})"


def MakeDate(year: Expr, month: Expr, day: Expr) -> Expr:
    """A date before 1970 fails the query."""

    def resolve(s):
        cols, nullable, name = _parts(s, "MAKEDATE", (year, month, day))
        t = _date(*cols)
        return Bound(name, DATETIME, nullable, F.when(micros(t) >= 0, t).when(micros(t) < 0, evaluation_error("date before 1970", "timestamp_ntz")))

    return single(resolve)


def MakeDatetime(year: Expr, month: Expr, day: Expr, hour: Expr, minute: Expr, second: Expr) -> Expr:
    """A time before 1970 is null."""

    def resolve(s):
        (y, mo, d, h, mi, sec), _, name = _parts(s, "MAKEDATETIME", (year, month, day, hour, minute, second))
        seconds = h.cast("bigint") * 3600 + mi.cast("bigint") * 60 + sec.cast("bigint")
        t = F.timestamp_add("SECOND", seconds, _date(y, mo, d))
        return Bound(name, DATETIME, True, F.when(micros(t) >= 0, t))

    return single(resolve)


def _part(what, take):
    return unary(what, _when, INT32, lambda x: take(x).cast("int"), convert=DATETIME)


def _local(x: Column, zone: str) -> Column:
    """The wall clock of a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), x)


def _local_part(what, take):
    def build(e: Expr, zone: str = "UTC") -> Expr:
        return unary(what, _when, INT32, lambda x: take(_local(x, zone)).cast("int"), convert=DATETIME)(e)

    return build


Year, YearLocal = _part("YEAR", F.year), _local_part("YEAR_LOCAL", F.year)
Quarter, QuarterLocal = _part("QUARTER", F.quarter), _local_part("QUARTER_LOCAL", F.quarter)
Month, MonthLocal = _part("MONTH", F.month), _local_part("MONTH_LOCAL", F.month)
Day, DayLocal = _part("DAY", F.dayofmonth), _local_part("DAY_LOCAL", F.dayofmonth)
Weekday, WeekdayLocal = _part("WEEKDAY", F.weekday), _local_part("WEEKDAY_LOCAL", F.weekday)
YearDay, YearDayLocal = _part("YEARDAY", F.dayofyear), _local_part("YEARDAY_LOCAL", F.dayofyear)
Hour, HourLocal = _part("HOUR", F.hour), _local_part("HOUR_LOCAL", F.hour)
Minute, MinuteLocal = _part("MINUTE", F.minute), _local_part("MINUTE_LOCAL", F.minute)
Second = _part("SECOND", F.second)
Microsecond = _part("MICROSECOND", lambda x: F.pmod(micros(x), F.lit(1_000_000)))


def SecondLocal(e: Expr, zone: str = "UTC") -> Expr:
    return Second(e)


def MicrosecondLocal(e: Expr, zone: str = "UTC") -> Expr:
    return Microsecond(e)


def _adder(what, add):
    def build(e: Expr, n: Expr) -> Expr:
        def resolve(s):
            x, k = want(e.one(s), _when, what), want(n.one(s), INTEGERS, what)
            return Bound(f"{what}({x.name}, {k.name})", DATETIME, x.nullable or k.nullable, add(x.to(DATETIME), k.col.cast("bigint")))

        return single(resolve)

    return build


def _add_months(x: Column, n: Column) -> Column:
    """A day that the month lacks rolls into the next one."""
    day = F.dayofmonth(x)
    return F.timestamp_add("DAY", day - 1, F.timestamp_add("MONTH", n, F.timestamp_add("DAY", 1 - day, x)))


AddMinutes = _adder("ADD_MINUTES", lambda x, n: F.timestamp_add("MINUTE", n, x))
AddDays = _adder("ADD_DAYS", lambda x, n: F.timestamp_add("DAY", n, x))
AddMonths = _adder("ADD_MONTHS", _add_months)


def AddMinute(e: Expr) -> Expr:
    return AddMinutes(e, ConstInt64(1))


def AddDay(e: Expr) -> Expr:
    return AddDays(e, ConstInt64(1))


def AddMonth(e: Expr) -> Expr:
    return AddMonths(e, ConstInt64(1))


# formatting ----------------------------------------------------------------

#: strftime directives that Java's patterns express alike. Fixed values.
_JAVA = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "I": "hh", "p": "a",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "h": "MMM",
}
LONGEST = 32


def java_pattern(fmt: str) -> str | None:
    """The format for ``date_format``, or None where only strftime will do."""
    out, i = [], 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%":
            i += 1
            if i == len(fmt):
                return None
            if fmt[i] == "%":
                out.append("'%'")
            elif fmt[i] in _JAVA:
                out.append(_JAVA[fmt[i]])
            else:
                return None
        else:
            out.append("''" if c == "'" else f"'{c}'")
        i += 1
    # Two quoted stretches in a row would read as one quote.
    return "".join(out).replace("''", "") if "'" not in fmt else None


@F.pandas_udf(T.StringType())
def _strftime(when: pd.Series, fmt: pd.Series) -> pd.Series:
    def one(t, f):
        return None if pd.isna(t) or f is None else pd.Timestamp(t).strftime(f)

    return pd.Series([one(t, f) for t, f in zip(when, fmt)], dtype=object)


def _formatted(x: Column, fmt: Bound, constant: str | None) -> Column:
    pattern = java_pattern(constant) if constant is not None else None
    text = F.date_format(x, pattern) if pattern else _strftime(x, fmt.col)
    return F.when(F.octet_length(text) > LONGEST, "").otherwise(text)


def DateFormat(e: Expr, fmt: Expr | str, zone: str | None = None) -> Expr:
    """strftime; a result of more than 32 bytes is empty."""
    from .terminals import ConstString

    constant = fmt if isinstance(fmt, str) else None
    pattern = ConstString(fmt) if isinstance(fmt, str) else fmt

    def resolve(s):
        x, f = want(e.one(s), _when, "DATE_FORMAT"), want(pattern.one(s), {STRING}, "DATE_FORMAT")
        t = x.to(DATETIME)
        return Bound(f"DATE_FORMAT({x.name}, {f.name})", STRING, x.nullable or f.nullable, _formatted(_local(t, zone) if zone else t, f, constant))

    return single(resolve)


def DateFormatLocal(e: Expr, fmt: Expr | str, zone: str = "UTC") -> Expr:
    return DateFormat(e, fmt, zone)


def ParseDateTime(fmt: str, e: Expr) -> Expr:
    from ..errors import fail

    fail("ERROR_NOT_IMPLEMENTED", "PARSE_DATETIME is declared only")


