"""Mathematics on doubles; each risky function has its failure policies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import BOOL, DOUBLE, FLOATS, INT32, INT64, INTEGERS, NUMERIC, STRING, UINT32, UINT64
from .arithmetic import quiet_divide
from .core import Bound, Expr, always, binary, evaluation_error, single, unary, want

_INF, _NAN = float("inf"), float("nan")


def _fn(what, make, nullable=None):
    return unary(what, NUMERIC, DOUBLE, make, nullable=nullable, convert=DOUBLE)


def _quiet_log(log):
    return lambda x: F.when(x == 0, F.lit(-_INF)).when((x < 0) | F.isnan(x), F.lit(_NAN)).otherwise(log(x))


def _nulling_log(log):
    return lambda x: F.when(x > 0, log(x))


Exp = _fn("EXP", lambda x: F.exp(x))
LnNulling, LnQuiet = _fn("LN", _nulling_log(F.ln), always), _fn("LN", _quiet_log(F.ln))
Log10Nulling, Log10Quiet = _fn("LOG10", _nulling_log(F.log10), always), _fn("LOG10", _quiet_log(F.log10))
Log2Nulling, Log2Quiet = _fn("LOG2", _nulling_log(F.log2), always), _fn("LOG2", _quiet_log(F.log2))
LogNulling = binary("LOG", NUMERIC, DOUBLE, lambda base, x: F.try_divide(_nulling_log(F.ln)(x), _nulling_log(F.ln)(base)), nullable=always, convert=DOUBLE)
LogQuiet = binary("LOG", NUMERIC, DOUBLE, lambda base, x: quiet_divide(_quiet_log(F.ln)(x), _quiet_log(F.ln)(base)), convert=DOUBLE)
Ln, Log10, Log = LnNulling, Log10Nulling, LogNulling

Sin, Cos, Tan, Cot = _fn("SIN", lambda x: F.sin(x)), _fn("COS", lambda x: F.cos(x)), _fn("TAN", lambda x: F.tan(x)), _fn("COT", lambda x: quiet_divide(F.lit(1.0), F.tan(x)))
Asin, Acos, Atan = _fn("ASIN", lambda x: F.asin(x)), _fn("ACOS", lambda x: F.acos(x)), _fn("ATAN", lambda x: F.atan(x))
Sinh, Cosh, Tanh = _fn("SINH", lambda x: F.sinh(x)), _fn("COSH", lambda x: F.cosh(x)), _fn("TANH", lambda x: F.tanh(x))
Asinh, Acosh, Atanh = _fn("ASINH", lambda x: F.asinh(x)), _fn("ACOSH", lambda x: F.acosh(x)), _fn("ATANH", lambda x: F.atanh(x))
Atan2 = binary("ATAN2", NUMERIC, DOUBLE, lambda a, b: F.atan2(a, b), convert=DOUBLE)
ToDegrees, ToRadians = _fn("TO_DEGREES", lambda x: F.degrees(x)), _fn("TO_RADIANS", lambda x: F.radians(x))


def Pi() -> Expr:
    return single(lambda s: Bound("PI", DOUBLE, False, F.pi()))


def _unsigned_abs(x, kind):
    return F.abs(x) if kind in FLOATS else F.abs(x.cast("bigint")).cast("bigint") if kind == INT32 else F.abs(x.cast("decimal(20,0)")).cast("decimal(20,0)") if kind == INT64 else x


Abs = unary("ABS", NUMERIC, lambda kind: {INT32: UINT32, INT64: UINT64}.get(kind, kind), _unsigned_abs)

# rounding ------------------------------------------------------------------

#: From here on doubles are whole.
_WHOLE = 2.0**52


def _keeping(what, step):
    """Rounding that keeps the type; integers pass."""

    def make(x, kind):
        if kind in INTEGERS:
            return x
        return F.when(F.abs(x) < _WHOLE, step(x)).otherwise(x).cast(kind.spark)

    return unary(what, NUMERIC, lambda kind: kind, make)


#: The double below 0.5. Adding it moves halves, and nothing less, to the next whole number.
_BELOW_HALF = 0.49999999999999994


def _away(x: Column) -> Column:
    """Half away from zero, exactly: 0.49999999999999994 is 0. One reference to the
    argument but for the sign, as Spark inlines it at each."""
    return F.signum(x) * F.floor(F.abs(x) + _BELOW_HALF)


Round = _keeping("ROUND", _away)
Ceil = _keeping("CEIL", lambda x: F.ceil(x))
Floor = _keeping("FLOOR", lambda x: F.floor(x))
Trunc = _keeping("TRUNC", lambda x: F.signum(x) * F.floor(F.abs(x)))


def _to_int(what, step):
    return unary(what, NUMERIC, INT64, lambda x, kind: x.cast("bigint") if kind in INTEGERS else step(x).cast("bigint"))


RoundToInt, CeilToInt, FloorToInt = _to_int("ROUND_TO_INT", _away), _to_int("CEIL_TO_INT", F.ceil), _to_int("FLOOR_TO_INT", F.floor)


def RoundWithPrecision(e: Expr, precision: Expr) -> Expr:
    """In binary: round(x * 10 ** p) / 10 ** p."""

    def resolve(s):
        x, p = want(e.one(s), NUMERIC, "ROUND"), want(precision.one(s), INTEGERS, "ROUND")
        scale = F.pow(F.lit(10.0), p.col.cast("double"))
        scaled = x.to(DOUBLE) * scale
        kind = x.type if x.type in FLOATS else DOUBLE
        return Bound(f"ROUND({x.name}, {p.name})", kind, x.nullable or p.nullable, (F.when(F.abs(scaled) < _WHOLE, _away(scaled)).otherwise(scaled) / scale).cast(kind.spark))

    return single(resolve)


# roots and powers ----------------------------------------------------------

SqrtSignaling = _fn("SQRT", lambda x: F.when(x < 0, evaluation_error("square root of a negative number", "double")).otherwise(F.sqrt(x)))
SqrtNulling = _fn("SQRT", lambda x: F.when(~(x < 0), F.sqrt(x)), always)
SqrtQuiet = _fn("SQRT", lambda x: F.sqrt(x))
Sqrt = SqrtQuiet


def _bad_power(b: Column, e: Column) -> Column:
    return (b < 0) & (e != F.floor(e))


PowerSignaling = binary("POWER", NUMERIC, DOUBLE, lambda b, e: F.when(_bad_power(b, e), evaluation_error("negative base", "double")).otherwise(F.pow(b, e)), convert=DOUBLE)
PowerNulling = binary("POWER", NUMERIC, DOUBLE, lambda b, e: F.when(~_bad_power(b, e), F.pow(b, e)), nullable=always, convert=DOUBLE)
PowerQuiet = binary("POWER", NUMERIC, DOUBLE, lambda b, e: F.pow(b, e), convert=DOUBLE)

# classes and text ----------------------------------------------------------


def _class(what, test):
    return unary(what, NUMERIC, BOOL, lambda x: F.when(x.isNotNull(), test(x)), convert=DOUBLE)


IsFinite = _class("IS_FINITE", lambda x: ~F.isnan(x) & (F.abs(x) < _INF))
IsNormal = _class("IS_NORMAL", lambda x: ~F.isnan(x) & (F.abs(x) < _INF) & (F.abs(x) >= 2.2250738585072014e-308))
IsNaN = _class("IS_NAN", lambda x: F.isnan(x))
IsInf = _class("IS_INF", lambda x: ~F.isnan(x) & (F.abs(x) == _INF))


@F.pandas_udf(T.StringType())
def _fixed(values: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or pd.isna(d) else f"{v:.{int(d)}f}" for v, d in zip(values.astype(object), digits)], dtype=object)


def Format(e: Expr, precision: Expr) -> Expr:
    """``%.*f`` with exact binary rounding, which Java's formatter does not have."""

    def resolve(s):
        x, p = want(e.one(s), NUMERIC, "FORMAT"), want(precision.one(s), INTEGERS, "FORMAT")
        digits = F.when(p.col >= 0, p.col.cast("bigint")).when(p.col < 0, evaluation_error("negative precision", "bigint"))
        value = x.to(DOUBLE)
        return Bound(f"FORMAT({x.name}, {p.name})", STRING, x.nullable or p.nullable, F.when(value.isNotNull(), _fixed(value, digits)))

    return single(resolve)


def RandomDouble() -> Expr:
    from ..errors import fail

    fail("ERROR_NOT_IMPLEMENTED", "RANDOM_DOUBLE is declared only")


