"""Strings. Lengths, positions and case are by bytes and ASCII letters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import fail
from ..types import BINARY, BOOL, DATE, DATETIME, DOUBLE, ENUM, FLOAT, INT32, INTEGERS, STRING, UINT32
from .core import Bound, Expr, binary, single, unary, want

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()


def lower_ascii(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def upper_ascii(s: Column) -> Column:
    return F.translate(s, _LOWER, _UPPER)


def _float_text(x: Column, digits: int) -> Column:
    """``%.{digits}g`` or, if that is another number, two digits more. Whole numbers
    of moderate size, the usual case, stay in the JVM."""
    whole = (x == F.floor(x)) & (F.abs(x) < 10**digits) & ~x.cast("string").startswith("-0")
    slow = _printed(F.when(~F.coalesce(whole, F.lit(True)), x.cast("double")), digits)
    return F.when(whole, F.floor(x).cast("bigint").cast("string")).otherwise(slow)


def _printed(x: Column, digits: int) -> Column:
    import numpy as np

    narrow = digits == 6

    @F.pandas_udf(T.StringType())
    def text(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            short = f"{v:.{digits}g}"
            back = np.float32(short) if narrow else float(short)
            return short if back == v or v != v else f"{v:.{digits + 2}g}"

        return pd.Series([one(v) for v in values], dtype=object)

    return F.when(x.isNull(), None).when(F.isnan(x), "nan").otherwise(text(F.when(~F.isnan(x), x)))


def text_of(b: Bound) -> Column:
    """The printed form of a value."""
    x, kind = b.col, b.type
    if kind == STRING or kind in INTEGERS:
        return x.cast("string")
    if kind == DOUBLE:
        return _float_text(x, 15)
    if kind == FLOAT:
        return _float_text(x, 6)
    if kind == BOOL:
        return F.when(x, "TRUE").when(~x, "FALSE")
    if kind == DATETIME:
        return F.date_format(x, "yyyy/MM/dd-HH:mm:ss")
    if kind == DATE:
        return F.date_format(x, "yyyy/MM/dd")
    if kind == BINARY:
        return F.concat(F.lit("<0x"), F.hex(x), F.lit(">"))
    if kind == ENUM:
        pairs = [F.lit(v) for pair in b.enum for v in pair]
        return F.try_element_at(F.create_map(*pairs), x) if pairs else x.cast("string")
    return x


def ToString(e: Expr) -> Expr:
    def resolve(s):
        b = e.one(s)
        return Bound(f"TO_STRING({b.name})", STRING, b.nullable, text_of(b))

    return single(resolve)


def Concat(parts: list[Expr]) -> Expr:
    def resolve(s):
        bound = [b for p in parts for b in p.bind(s)]
        return Bound(f"CONCAT({', '.join(b.name for b in bound)})", STRING, any(b.nullable for b in bound), F.concat(*map(text_of, bound)))

    return single(resolve)


_text = {STRING}
Length = unary("LENGTH", {STRING, BINARY}, UINT32, lambda x: F.octet_length(x).cast("bigint"))
Ltrim = unary("LTRIM", _text, STRING, lambda x: F.ltrim(x))
Rtrim = unary("RTRIM", _text, STRING, lambda x: F.rtrim(x))
Trim = unary("TRIM", _text, STRING, lambda x: F.trim(x))
ToUpper = unary("TO_UPPER", _text, STRING, lambda x: upper_ascii(x))
ToLower = unary("TO_LOWER", _text, STRING, lambda x: lower_ascii(x))


def _bytes_from(x: Column, start: Column, length: Column) -> Column:
    """Bytes of a string from a 1-based position; whole characters where they are ASCII."""
    return F.substring(x.cast("binary"), start, length).cast("string")


def _start(x: Column, pos: Column) -> Column:
    n = F.octet_length(x).cast("bigint")
    p = pos.cast("bigint")
    return F.least(F.when(p > 0, p).otherwise(F.greatest(p + n + 1, F.lit(1).cast("bigint"))), n + 1).cast("int")


def TrailingSubstring(e: Expr, pos: Expr) -> Expr:
    def resolve(s):
        x, p = want(e.one(s), _text, "SUBSTRING"), want(pos.one(s), INTEGERS, "SUBSTRING")
        return Bound(f"SUBSTRING({x.name}, {p.name})", STRING, x.nullable or p.nullable, _bytes_from(x.col, _start(x.col, p.col), F.octet_length(x.col)))

    return single(resolve)


def Substring(e: Expr, pos: Expr, length: Expr) -> Expr:
    def resolve(s):
        x, p, n = want(e.one(s), _text, "SUBSTRING"), want(pos.one(s), INTEGERS, "SUBSTRING"), want(length.one(s), INTEGERS, "SUBSTRING")
        size = F.least(F.greatest(n.col.cast("bigint"), F.lit(0).cast("bigint")), F.octet_length(x.col).cast("bigint")).cast("int")
        return Bound(f"SUBSTRING({x.name}, {p.name}, {n.name})", STRING, x.nullable or p.nullable or n.nullable, _bytes_from(x.col, _start(x.col, p.col), F.when(n.col.isNotNull(), size)))

    return single(resolve)


def _offset(hay: Column, needle: Column) -> Column:
    """Position in bytes."""
    chars = F.call_function("locate", needle, hay)
    return F.when(chars > 0, F.octet_length(F.substring(hay, F.lit(1), chars - 1)) + 1).otherwise(chars).cast("int")


StringOffset = binary("STRING_OFFSET", _text, INT32, _offset)
StringContains = binary("CONTAINS", _text, BOOL, lambda a, b: F.contains(a, b))
StringContainsCI = binary("CONTAINS_CI", _text, BOOL, lambda a, b: F.contains(lower_ascii(a), lower_ascii(b)))


def StringReplace(hay: Expr, needle: Expr, new: Expr) -> Expr:
    def resolve(s):
        a, b, c = (want(x.one(s), _text, "REPLACE") for x in (hay, needle, new))
        return Bound(f"REPLACE({a.name}, {b.name}, {c.name})", STRING, a.nullable or b.nullable or c.nullable, F.replace(a.col, b.col, c.col))

    return single(resolve)


def ConcatWithSeparator(separator: Expr, parts: list[Expr]) -> Expr:
    fail("ERROR_NOT_IMPLEMENTED", "CONCAT with a separator is declared only")
