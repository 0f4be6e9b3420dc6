"""Arithmetic. Integers wrap around; division has its three policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, DOUBLE, FLOATS, INT32, INT64, INTEGERS, NUMERIC, UINT32, UINT64, DataType, fit
from .core import always, binary, evaluation_error, unary

_TWO_32 = 2**32


def _dec(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _plus(a, b, kind):
    if kind in FLOATS:
        return a + b
    if kind in (INT32, UINT32):
        return fit(a.cast("bigint") + b.cast("bigint"), kind)
    # The sum as it is, unless it overflows; the slow way only then.
    return F.coalesce(F.try_add(a, b), fit(_dec(a) + _dec(b), kind)) if kind == INT64 else fit(_dec(a) + _dec(b), kind)


def _minus(a, b, kind):
    if kind in FLOATS:
        return a - b
    if kind in (INT32, UINT32):
        return fit(a.cast("bigint") - b.cast("bigint"), kind)
    return F.coalesce(F.try_subtract(a, b), fit(_dec(a) - _dec(b), kind)) if kind == INT64 else fit(_dec(a) - _dec(b), kind)


def _wide_product(a: Column, b: Column, kind: DataType) -> Column:
    """Modulo 2 ** 64 by halves of ``a``, as a whole product has too many digits."""
    size, half = F.lit(str(2**64)).cast("decimal(38,0)"), F.lit(str(_TWO_32)).cast("decimal(38,0)")
    x, y = F.pmod(_dec(a), size), F.pmod(_dec(b), size)
    low = F.pmod(x, half)
    high = ((x - low) / half).cast("decimal(10,0)")
    part = lambda v: F.pmod((v.cast("decimal(11,0)") * y.cast("decimal(20,0)")).cast("decimal(38,0)"), size)
    return fit(part(low) + F.pmod(part(high), half) * half, kind)


def _times(a, b, kind):
    if kind in FLOATS:
        return a * b
    if kind == INT32:
        return fit(a.cast("bigint") * b.cast("bigint"), kind)
    if kind == UINT32:
        return fit(_dec(a) * _dec(b), kind)
    return F.coalesce(F.try_multiply(a, b), _wide_product(a, b, kind)) if kind == INT64 else _wide_product(a, b, kind)


def same(kind: DataType) -> DataType:
    return kind


Plus = binary("ADD", NUMERIC, same, _plus)
Minus = binary("SUBTRACT", NUMERIC, same, _minus)
Multiply = binary("MULTIPLY", NUMERIC, same, _times)


def quiet_divide(a: Column, b: Column) -> Column:
    """IEEE 754: x/0 is an infinity or NaN, 0 having a sign."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b != 0, b))


DivideSignaling = binary("DIVIDE_SIGNALING", NUMERIC, DOUBLE, lambda a, b: a / b, convert=DOUBLE)
DivideNulling = binary("DIVIDE_NULLING", NUMERIC, DOUBLE, lambda a, b: F.try_divide(a, b), nullable=always, convert=DOUBLE)
DivideQuiet = binary("DIVIDE_QUIET", NUMERIC, DOUBLE, lambda a, b: quiet_divide(a, b), convert=DOUBLE)
Divide = DivideSignaling


def _whole_quotient(a, b, kind):
    """``a`` over a ``b`` that is null instead of 0, toward zero."""
    if kind in FLOATS:
        return a / b
    if kind == UINT64:
        return ((a - F.try_mod(a, b)) / b).cast("decimal(20,0)")
    if kind == INT64:  # the one quotient that overflows wraps
        return F.when(b == -1, _minus(F.lit(0).cast("bigint"), a, INT64)).otherwise(F.call_function("div", a, b))
    return fit(F.call_function("div", a.cast("bigint"), b.cast("bigint")), kind)


def _cpp_nulling(a, b, kind):
    return _whole_quotient(a, F.when(b != 0, b), kind)


def _cpp_signaling(a, b, kind):
    checked = F.when(b != 0, b).when(b == 0, evaluation_error("division by zero", kind.spark))
    return _whole_quotient(a, checked, kind)


CppDivideNulling = binary("CPP_DIVIDE_NULLING", NUMERIC, same, _cpp_nulling, nullable=always)
CppDivideSignaling = binary("CPP_DIVIDE_SIGNALING", NUMERIC, same, _cpp_signaling)
CppDivide = CppDivideSignaling


def _negate(x, kind):
    if kind in FLOATS:
        return -x
    signed = {INT32: INT32, UINT32: INT32, INT64: INT64, UINT64: INT64}[kind]
    return fit(-x.cast("bigint"), signed) if signed == INT32 else fit(-_dec(x), signed)


Negate = unary("NEGATE", NUMERIC, lambda kind: {UINT32: INT32, UINT64: INT64}.get(kind, kind), _negate)


def _rest(a, b, kind):
    return F.try_mod(a, b).cast(kind.spark)


def _rest_or_fail(a, b, kind):
    return F.try_mod(a, F.when(b != 0, b).when(b == 0, evaluation_error("modulus by zero", kind.spark))).cast(kind.spark)


ModulusNulling = binary("MODULUS_NULLING", INTEGERS, same, _rest, nullable=always)
ModulusSignaling = binary("MODULUS_SIGNALING", INTEGERS, same, _rest_or_fail)
Modulus = ModulusSignaling
IsOdd = unary("IS_ODD", INTEGERS, BOOL, lambda x: x % 2 != 0)
IsEven = unary("IS_EVEN", INTEGERS, BOOL, lambda x: x % 2 == 0)
