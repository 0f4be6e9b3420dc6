"""Data types, schemas and the rules by which types meet.

Unsigned and enum types have no Spark type of their own: UINT32 is kept as bigint
and UINT64 as decimal(20,0); the column's metadata says what it is.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import fail


class DataType(Enum):
    INT32 = "int"
    INT64 = "bigint"
    UINT32 = "uint32"
    UINT64 = "decimal(20,0)"
    FLOAT = "float"
    DOUBLE = "double"
    BOOL = "boolean"
    ENUM = "enum"
    STRING = "string"
    BINARY = "binary"
    DATETIME = "timestamp_ntz"
    DATE = "date"
    DATA_TYPE = "data_type"

    @property
    def spark(self) -> str:
        return {"uint32": "bigint", "enum": "int", "data_type": "string"}.get(self.value, self.value)


INT32, INT64, UINT32, UINT64, FLOAT, DOUBLE, BOOL, ENUM, STRING, BINARY, DATETIME, DATE, DATA_TYPE = DataType
INTEGERS = {INT32, INT64, UINT32, UINT64}
FLOATS = {FLOAT, DOUBLE}
NUMERIC = INTEGERS | FLOATS
METADATA = "skeinwork.type"
ENUM_METADATA = "skeinwork.enum"


@dataclass(frozen=True)
class Attribute:
    name: str
    type: DataType
    nullable: bool = True
    enum: tuple[tuple[int, str], ...] = ()

    def metadata(self) -> dict:
        out = {METADATA: self.type.name}
        if self.enum:
            out[ENUM_METADATA] = [f"{n}={s}" for n, s in self.enum]
        return out


def enum_definition(values: dict[str, int]) -> tuple[tuple[int, str], ...]:
    """Names and numbers, both unique."""
    if len(set(values.values())) < len(values):
        fail("ERROR_DUPLICATE_ENUM_VALUE_NUMBER", f"numbers repeat in {values}")
    return tuple(sorted((n, s) for s, n in values.items()))


class Schema:
    """Attributes with unique names."""

    def __init__(self, attributes: list[Attribute]):
        self.attributes = list(attributes)
        seen: set[str] = set()
        for a in self.attributes:
            if a.name in seen:
                fail("ERROR_ATTRIBUTE_EXISTS", f"attribute {a.name!r} is there twice")
            seen.add(a.name)

    def __len__(self):
        return len(self.attributes)

    def __iter__(self):
        return iter(self.attributes)

    def __eq__(self, other):
        return isinstance(other, Schema) and self.attributes == other.attributes

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.attributes]

    def __getitem__(self, name: str) -> Attribute:
        for a in self.attributes:
            if a.name == name:
                return a
        fail("ERROR_ATTRIBUTE_MISSING", f"no attribute {name!r} among {self.names}")

    def at(self, i: int) -> Attribute:
        if not 0 <= i < len(self.attributes):
            fail("ERROR_ATTRIBUTE_MISSING", f"no attribute at {i}")
        return self.attributes[i]

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(a.name, T._parse_datatype_string(a.type.spark), a.nullable, a.metadata()) for a in self.attributes])


_BY_SPARK = {
    T.ByteType: INT32,
    T.ShortType: INT32,
    T.IntegerType: INT32,
    T.LongType: INT64,
    T.FloatType: FLOAT,
    T.DoubleType: DOUBLE,
    T.BooleanType: BOOL,
    T.StringType: STRING,
    T.BinaryType: BINARY,
    T.TimestampNTZType: DATETIME,
    T.TimestampType: DATETIME,
    T.DateType: DATE,
}


def schema_of(df: DataFrame) -> Schema:
    """The schema of a DataFrame; a column's metadata wins over its Spark type."""
    out = []
    for f in df.schema.fields:
        named = f.metadata.get(METADATA)
        if named:
            kind = DataType[named]
        elif isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0:
            kind = UINT64
        elif type(f.dataType) in _BY_SPARK:
            kind = _BY_SPARK[type(f.dataType)]
        else:
            continue  # nested columns pass through unseen
        enum = tuple((int(n), s) for n, s in (x.split("=", 1) for x in f.metadata.get(ENUM_METADATA, ())))
        out.append(Attribute(f.name, kind, f.nullable, enum))
    return Schema(out)


def common_type(a: DataType, b: DataType) -> DataType:
    """The type that implicit promotion takes two operands to."""
    if a == b:
        return a
    pair = {a, b}
    if pair <= NUMERIC:
        if DOUBLE in pair:
            return DOUBLE
        if FLOAT in pair:
            return DOUBLE if pair & {INT64, UINT64} else FLOAT
        return UINT64 if pair == {UINT64, UINT32} else INT64
    if pair == {DATE, DATETIME}:
        return DATETIME
    fail("ERROR_ATTRIBUTE_TYPE_MISMATCH", f"{a.name} and {b.name} have no common type")


def _wrap(x: Column, bits: int, signed: bool) -> Column:
    """``x``, an integer of any width, modulo 2 ** bits."""
    wide = x.cast("decimal(38,0)")
    size, low = F.lit(str(2**bits)).cast("decimal(38,0)"), F.lit(str(2 ** (bits - 1) if signed else 0)).cast("decimal(38,0)")
    return F.pmod(wide + low, size) - low


def fit(x: Column, kind: DataType) -> Column:
    """``x`` wrapped into an integer type."""
    if kind == INT32:
        return (F.pmod(x.cast("bigint") + 2**31, F.lit(2**32)) - 2**31).cast("int")
    if kind == UINT32:
        return F.pmod(x, F.lit(2**32)).cast("bigint")
    return _wrap(x, 64, kind == INT64).cast(kind.spark)


#: From each type, the types that implicit promotion and an explicit cast reach.
_CASTS = {
    INT32: (INTEGERS | FLOATS, set()),
    UINT32: (INTEGERS | FLOATS, set()),
    INT64: ({UINT64, DOUBLE}, {INT32, UINT32, FLOAT}),
    UINT64: ({INT64, DOUBLE}, {INT32, UINT32, FLOAT}),
    FLOAT: ({DOUBLE}, set()),
    DOUBLE: (set(), {FLOAT}),
    STRING: ({BINARY}, set()),
    BINARY: ({STRING}, set()),
    DATE: ({DATETIME}, set()),
}


def cast(x: Column, a: DataType, b: DataType, explicit: bool = False) -> Column:
    """``x`` of type ``a`` as ``b``, where that is allowed."""
    if a == b:
        return x
    implied, asked = _CASTS.get(a, (set(), set()))
    if b not in implied and not (explicit and b in asked):
        hint = "; use a rounding function" if a in FLOATS and b in INTEGERS else ""
        fail("ERROR_ATTRIBUTE_TYPE_MISMATCH", f"{a.name} is not cast to {b.name}{hint}")
    if b in INTEGERS:
        exact = (a, b) in {(INT32, INT64), (UINT32, INT64), (UINT32, UINT64)}
        return x.cast(b.spark) if exact else fit(x, b)
    return x.cast(b.spark)


def promoted(a: Attribute, **changes) -> Attribute:
    return replace(a, **changes)
