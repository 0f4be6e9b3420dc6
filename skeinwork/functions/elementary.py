"""Casts, parsing, control flow, logic, bits, comparison and membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import fail
from ..types import BINARY, BOOL, DATE, DATETIME, DOUBLE, FLOAT, FLOATS, INT32, INT64, INTEGERS, NUMERIC, STRING, UINT32, UINT64, DataType, cast, common_type
from .core import Bound, Expr, binary, single, unary, want

# casts and parsing ---------------------------------------------------------


def CastTo(kind: DataType, e: Expr) -> Expr:
    def resolve(s):
        b = e.one(s)
        return Bound(f"CAST_TO_{kind.name}({b.name})", kind, b.nullable, cast(b.col, b.type, kind, explicit=True))

    return single(resolve)


_DATETIME_END = "2038-01-19 03:14:07"


def parse_datetime(s: Column, pattern: str) -> Column:
    """Between 1970 and the end of 32-bit seconds, else null."""
    t = F.try_to_timestamp(F.trim(s), F.lit(pattern)).cast("timestamp_ntz")
    return F.when((t >= F.lit("1970-01-01").cast("timestamp_ntz")) & (t <= F.lit(_DATETIME_END).cast("timestamp_ntz")), t)


def _parsed(x: Column, kind: DataType) -> Column:
    t = F.trim(x)
    if kind == BOOL:
        low = F.lower(t)
        return F.when(low.isin("true", "yes"), True).when(low.isin("false", "no"), False)
    if kind in INTEGERS:
        whole = F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("decimal(38,0)"))
        low, high = {INT32: (-(2**31), 2**31 - 1), INT64: (-(2**63), 2**63 - 1), UINT32: (0, 2**32 - 1), UINT64: (0, 2**64 - 1)}[kind]
        bound = lambda v: F.lit(str(v)).cast("decimal(38,0)")
        return F.when((whole >= bound(low)) & (whole <= bound(high)), whole.try_cast(kind.spark))
    if kind in FLOATS:
        return F.when(~F.lower(t).rlike("[df]$") | F.lower(t).rlike("inf$"), t.try_cast(kind.spark))
    if kind == DATETIME:
        return parse_datetime(x, "yyyy/M/d-H:m:s")
    if kind == DATE:
        return parse_datetime(x, "yyyy/M/d").cast("date")
    if kind in (STRING, BINARY):
        return x.cast(kind.spark)
    fail("ERROR_INVALID_ARGUMENT_TYPE", f"{kind.name} is not parsed")


def ParseStringNulling(kind: DataType, e: Expr) -> Expr:
    def resolve(s):
        b = want(e.one(s), {STRING}, "PARSE_STRING")
        return Bound(f"PARSE_STRING_{kind.name}({b.name})", kind, True, _parsed(b.col, kind))

    return single(resolve)


#: Bad input has no specified value here; null is one.
ParseStringQuiet = ParseStringNulling

# control -------------------------------------------------------------------


def _branches(s, parts: list[Expr]) -> tuple[list[Bound], DataType]:
    bound = [p.one(s) for p in parts]
    return bound, reduce(common_type, (b.type for b in bound))


def If(cond: Expr, a: Expr, b: Expr) -> Expr:
    """A null condition takes the second branch."""

    def resolve(s):
        c = want(cond.one(s), {BOOL}, "IF")
        (x, y), kind = _branches(s, [a, b])
        return Bound(f"IF({c.name}, {x.name}, {y.name})", kind, x.nullable or y.nullable, F.when(c.col, x.to(kind)).otherwise(y.to(kind)))

    return single(resolve)


def NullingIf(cond: Expr, a: Expr, b: Expr) -> Expr:
    """A null condition gives null."""

    def resolve(s):
        c = want(cond.one(s), {BOOL}, "IF")
        (x, y), kind = _branches(s, [a, b])
        return Bound(f"IF({c.name}, {x.name}, {y.name})", kind, c.nullable or x.nullable or y.nullable, F.when(c.col, x.to(kind)).when(~c.col, y.to(kind)))

    return single(resolve)


def IfNull(e: Expr, other: Expr) -> Expr:
    def resolve(s):
        (x, y), kind = _branches(s, [e, other])
        col = F.coalesce(x.to(kind), y.to(kind)) if x.nullable else x.to(kind)
        return Bound(f"IFNULL({x.name}, {y.name})", kind, x.nullable and y.nullable, col)

    return single(resolve)


def Case(arguments: list[Expr]) -> Expr:
    """Test, else, then pairs of when and then. A null test matches nothing."""
    if len(arguments) < 2 or len(arguments) % 2:
        fail("ERROR_ATTRIBUTE_COUNT_MISMATCH", "CASE takes an even number of arguments, two at least")

    def resolve(s):
        tests, test_kind = _branches(s, [arguments[0], *arguments[2::2]])
        results, kind = _branches(s, [arguments[1], *arguments[3::2]])
        col = None
        for w, t in zip(tests[1:], results[1:]):
            hit = equal(tests[0].to(test_kind), w.to(test_kind), test_kind)
            col = F.when(hit, t.to(kind)) if col is None else col.when(hit, t.to(kind))
        col = results[0].to(kind) if col is None else col.otherwise(results[0].to(kind))
        return Bound(f"CASE({tests[0].name})", kind, any(r.nullable for r in results), col)

    return single(resolve)


# logic ---------------------------------------------------------------------

_logical = {BOOL}
And = binary("AND", _logical, BOOL, lambda a, b: a & b)
AndNot = binary("AND_NOT", _logical, BOOL, lambda a, b: ~a & b)
Or = binary("OR", _logical, BOOL, lambda a, b: a | b)
Xor = binary("XOR", _logical, BOOL, lambda a, b: a != b)
Not = unary("NOT", _logical, BOOL, lambda a: ~a)
IsNull = unary("ISNULL", set(DataType), BOOL, lambda a: a.isNull(), nullable=lambda n: False)

# bits ----------------------------------------------------------------------



def _bits(what, make):
    """Through 64-bit integers; UINT64 by its bit pattern."""

    def apply(a, b, kind):
        if kind == UINT64:
            return _from_pattern(make(_pattern(a), _pattern(b)))
        return _in_kind(make(a, b), kind)

    return binary(what, INTEGERS, lambda kind: kind, apply)


def _pattern(x: Column) -> Column:
    """A UINT64 as the bigint of the same bits."""
    return F.when(x >= F.lit(str(2**63)).cast("decimal(20,0)"), (x - F.lit(str(2**64)).cast("decimal(20,0)"))).otherwise(x).cast("bigint")


def _from_pattern(x: Column) -> Column:
    wide = x.cast("decimal(21,0)")
    return F.when(x < 0, wide + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def _in_kind(x: Column, kind: DataType) -> Column:
    return x.bitwiseAND(F.lit(2**32 - 1)) if kind == UINT32 else x.cast(kind.spark)


BitwiseAnd = _bits("BITWISE_AND", lambda a, b: a.bitwiseAND(b))
BitwiseAndNot = _bits("BITWISE_AND_NOT", lambda a, b: F.bitwise_not(a).bitwiseAND(b))
BitwiseOr = _bits("BITWISE_OR", lambda a, b: a.bitwiseOR(b))
BitwiseXor = _bits("BITWISE_XOR", lambda a, b: a.bitwiseXOR(b))


def _not(x, kind):
    return _from_pattern(F.bitwise_not(_pattern(x))) if kind == UINT64 else _in_kind(F.bitwise_not(x), kind)


BitwiseNot = unary("BITWISE_NOT", INTEGERS, lambda kind: kind, _not)


def _shift(what, make):
    def build(a: Expr, n: Expr) -> Expr:
        def resolve(s):
            x, k = want(a.one(s), INTEGERS, what), want(n.one(s), INTEGERS, what)
            return Bound(f"{what}({x.name}, {k.name})", x.type, x.nullable or k.nullable, make(x.col, k.col.cast("int"), x.type))

        return single(resolve)

    return build


def _left(x, n, kind):
    f = F.call_function
    return _from_pattern(f("shiftleft", _pattern(x), n)) if kind == UINT64 else _in_kind(f("shiftleft", x, n), kind)


def _right(x, n, kind):
    f = F.call_function
    return _from_pattern(f("shiftrightunsigned", _pattern(x), n)) if kind == UINT64 else f("shiftright", x, n)


ShiftLeft = _shift("SHIFT_LEFT", _left)
ShiftRight = _shift("SHIFT_RIGHT", _right)

# comparison ----------------------------------------------------------------


def comparison_type(a: DataType, b: DataType) -> DataType:
    if a == b:
        return a
    if not {a, b} <= NUMERIC:
        fail("ERROR_ATTRIBUTE_TYPE_MISMATCH", f"{a.name} and {b.name} are not compared")
    return DOUBLE if DOUBLE in (a, b) else FLOAT if FLOAT in (a, b) else UINT64 if UINT64 in (a, b) else INT64


def equal(a: Column, b: Column, kind: DataType) -> Column:
    """NaN equals nothing, unlike in Spark."""
    return (a == b) & ~F.isnan(a) if kind in FLOATS else a == b


def _less(a, b, kind):
    return (a < b) & ~F.isnan(b) if kind in FLOATS else a < b


def _less_or_equal(a, b, kind):
    return (a <= b) & ~F.isnan(a) & ~F.isnan(b) if kind in FLOATS else a <= b


def _compare(what, make):
    def build(a: Expr, b: Expr) -> Expr:
        def resolve(s):
            x, y = a.one(s), b.one(s)
            kind = comparison_type(x.type, y.type)
            cols = (x.col.cast(kind.spark), y.col.cast(kind.spark)) if x.type != y.type else (x.col, y.col)
            return Bound(f"{what}({x.name}, {y.name})", BOOL, x.nullable or y.nullable, make(*cols, kind))

        return single(resolve)

    return build


Equal = _compare("EQUAL", equal)
NotEqual = _compare("NOT_EQUAL", lambda a, b, kind: ~equal(a, b, kind))
Less = _compare("LESS", _less)
LessOrEqual = _compare("LESS_OR_EQUAL", _less_or_equal)
Greater = _compare("GREATER", lambda a, b, kind: _less(b, a, kind))
GreaterOrEqual = _compare("GREATER_OR_EQUAL", lambda a, b, kind: _less_or_equal(b, a, kind))


def In(needle: Expr, haystack: list[Expr]) -> Expr:
    def resolve(s):
        bound, kind = _branches(s, [needle, *haystack])
        first, *rest = [b.to(kind) for b in bound]
        return Bound(f"IN({bound[0].name})", BOOL, any(b.nullable for b in bound), first.isin(*rest) if rest else F.when(first.isNotNull(), False))

    return single(resolve)
