"""Constants, attributes and the ways to combine several columns."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..errors import fail
from ..types import BINARY, BOOL, DATA_TYPE, DATE, DATETIME, DOUBLE, FLOAT, INT32, INT64, STRING, UINT32, UINT64, DataType
from .core import Bound, Expr, attribute_column, single


def Null(kind: DataType) -> Expr:
    return single(lambda s: Bound("NULL", kind, True, F.lit(None).cast(kind.spark)))


def _constant(kind: DataType, low=None, high=None):
    def build(value) -> Expr:
        if low is not None and not low <= value < high:
            fail("ERROR_INVALID_ARGUMENT_VALUE", f"{value} is no {kind.name}")
        return single(lambda s: Bound(f"CONST_{kind.name}", kind, False, F.lit(value).cast(kind.spark), constant=value))

    return build


ConstInt32 = _constant(INT32, -(2**31), 2**31)
ConstInt64 = _constant(INT64, -(2**63), 2**63)
ConstUint32 = _constant(UINT32, 0, 2**32)
ConstFloat, ConstDouble, ConstBool, ConstString = map(_constant, (FLOAT, DOUBLE, BOOL, STRING))


def ConstUint64(value: int) -> Expr:
    if not 0 <= value < 2**64:
        fail("ERROR_INVALID_ARGUMENT_VALUE", f"{value} is no UINT64")
    return single(lambda s: Bound("CONST_UINT64", UINT64, False, F.lit(str(value)).cast(UINT64.spark)))


def ConstBinary(value: bytes) -> Expr:
    return single(lambda s: Bound("CONST_BINARY", BINARY, False, F.lit(bytearray(value))))


def ConstDate(days: int) -> Expr:
    return single(lambda s: Bound("CONST_DATE", DATE, False, F.date_from_unix_date(F.lit(days))))


def ConstDateTime(micros: int) -> Expr:
    return single(lambda s: Bound("CONST_DATETIME", DATETIME, False, from_micros(F.lit(micros).cast("bigint"))))


def ConstDataType(kind: DataType) -> Expr:
    return single(lambda s: Bound("CONST_DATA_TYPE", DATA_TYPE, False, F.lit(kind.name)))


def from_micros(x):
    """Microseconds since the epoch as a timestamp without a zone, whatever the session's."""
    return F.timestamp_add("MICROSECOND", x, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def RandInt32(seed: int | None = None) -> Expr:
    draw = F.rand(seed) if seed is not None else F.rand()
    return single(lambda s: Bound("RANDOM_INT32", INT32, False, F.floor(draw * 2.0**32 - 2.0**31).cast("int")))


def now_micros() -> int:
    return int(datetime.now(timezone.utc).timestamp() * 1_000_000)


# --------------------------------------------------------------------------
# attributes and projectors: both are expressions here


def NamedAttribute(name: str) -> Expr:
    return single(lambda s: attribute_column(s[name]))


def AttributeAt(i: int) -> Expr:
    return single(lambda s: attribute_column(s.at(i)))


def Alias(name: str, e: Expr) -> Expr:
    def resolve(s):
        b = e.one(s)
        return Bound(name, b.type, b.nullable, b.col, b.enum)

    return single(resolve)


def Flat(*parts: Expr) -> Expr:
    """The columns of all parts; names must differ."""

    def resolve(s):
        out = [b for p in parts for b in p.bind(s)]
        names = [b.name for b in out]
        if len(set(names)) < len(names):
            fail("ERROR_ATTRIBUTE_EXISTS", f"names repeat: {names}")
        return out

    return Expr(resolve)


Projection = Flat


class CompoundExpression(Expr):
    """Several expressions, some of them renamed."""

    def __init__(self):
        self.parts: list[Expr] = []
        super().__init__(lambda s: Flat(*self.parts).bind(s))

    def add(self, e: Expr) -> CompoundExpression:
        self.parts.append(e)
        return self

    def add_as(self, name: str, e: Expr) -> CompoundExpression:
        return self.add(Alias(name, e))

    def add_as_multi(self, names: list[str], e: Expr) -> CompoundExpression:
        return self.add(ProjectRename(names, e))


def ProjectNamedAttribute(name: str) -> Expr:
    return NamedAttribute(name)


def ProjectNamedAttributeAs(name: str, alias: str) -> Expr:
    return Alias(alias, NamedAttribute(name))


def ProjectNamedAttributes(names: list[str]) -> Expr:
    return Flat(*map(NamedAttribute, names))


def ProjectAttributeAt(i: int) -> Expr:
    return AttributeAt(i)


def ProjectAttributeAtAs(i: int, alias: str) -> Expr:
    return Alias(alias, AttributeAt(i))


def ProjectAttributesAt(positions: list[int]) -> Expr:
    return Flat(*map(AttributeAt, positions))


def ProjectAllAttributes(prefix: str = "") -> Expr:
    def resolve(s):
        return [Bound(prefix + b.name, b.type, b.nullable, b.col, b.enum) for b in map(attribute_column, s)]

    return Expr(resolve)


def ProjectRename(names: list[str], e: Expr) -> Expr:
    def resolve(s):
        out = e.bind(s)
        if len(out) != len(names):
            fail("ERROR_ATTRIBUTE_COUNT_MISMATCH", f"{len(names)} names for {len(out)} columns")
        return [Bound(n, b.type, b.nullable, b.col, b.enum) for n, b in zip(names, out)]

    return Expr(resolve)


def ProjectRenameSingle(name: str, e: Expr) -> Expr:
    return ProjectRename([name], e)


CompoundSingleSourceProjector = CompoundExpression
InputAttributeProjection = Flat
