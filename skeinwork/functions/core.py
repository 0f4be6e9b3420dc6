"""Expressions: functions from a schema to named, typed columns.

An expression is a tree that knows no schema. ``bind`` resolves it: names are looked
up, types are checked and promoted, and a failure carries its code, all before
Spark sees a plan. What comes out are plain ``Column`` s.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import fail
from ..types import Attribute, DataType, Schema, cast, common_type, schema_of


@dataclass(frozen=True)
class Bound:
    """One resolved column."""

    name: str
    type: DataType
    nullable: bool
    col: Column
    enum: tuple = ()
    #: The value of a constant that later checks look at.
    constant: object = None

    def attribute(self) -> Attribute:
        return Attribute(self.name, self.type, self.nullable, self.enum)

    def output(self) -> Column:
        return self.col.alias(self.name, metadata=self.attribute().metadata())

    def to(self, kind: DataType) -> Column:
        return cast(self.col, self.type, kind)


class Expr:
    """``resolve`` takes a schema and returns the bound columns."""

    def __init__(self, resolve: Callable[[Schema], list[Bound]]):
        self.resolve = resolve

    def bind(self, schema: Schema) -> list[Bound]:
        return self.resolve(schema)

    def one(self, schema: Schema) -> Bound:
        out = self.resolve(schema)
        if len(out) != 1:
            fail("ERROR_ATTRIBUTE_COUNT_MISMATCH", f"one column is wanted, not {len(out)}")
        return out[0]


def single(resolve: Callable[[Schema], Bound]) -> Expr:
    return Expr(lambda schema: [resolve(schema)])


def attribute_column(a: Attribute) -> Bound:
    return Bound(a.name, a.type, a.nullable, F.col(f"`{a.name.replace('`', '``')}`"), a.enum)


def bound_select(df: DataFrame, columns: list[Bound]) -> DataFrame:
    """Select bound columns, whose names must differ."""
    Schema([b.attribute() for b in columns])
    return df.select(*(b.output() for b in columns))


def resolve_on(df: DataFrame, e: Expr) -> list[Bound]:
    return e.bind(schema_of(df))


def want(b: Bound, kinds, what: str) -> Bound:
    if b.type not in kinds:
        fail("ERROR_ATTRIBUTE_TYPE_MISMATCH", f"{what} does not take {b.type.name}")
    return b


def unary(what: str, kinds, out, make, nullable=None, convert: DataType | None = None) -> Callable[[Expr], Expr]:
    """A function of one argument. ``out``: its type or a function of the argument's;
    ``nullable``: a function of the argument's nullability; ``convert``: a type to
    which the argument is promoted first."""

    def build(e: Expr) -> Expr:
        def resolve(schema):
            b = want(e.one(schema), kinds, what)
            x = b.to(convert) if convert else b.col
            kind = out if isinstance(out, DataType) else out(b.type)
            result = make(x) if make.__code__.co_argcount == 1 else make(x, b.type)
            return Bound(f"{what}({b.name})", kind, b.nullable if nullable is None else nullable(b.nullable), result)

        return single(resolve)

    build.__name__ = what
    return build


def binary(what: str, kinds, out, make, nullable=None, convert: DataType | None = None) -> Callable[[Expr, Expr], Expr]:
    """A function of two arguments, promoted to their common type or to ``convert``."""

    def build(a: Expr, b: Expr) -> Expr:
        def resolve(schema):
            x, y = want(a.one(schema), kinds, what), want(b.one(schema), kinds, what)
            kind = convert or common_type(x.type, y.type)
            cx, cy = x.to(kind), y.to(kind)
            result = make(cx, cy) if make.__code__.co_argcount == 2 else make(cx, cy, kind)
            to = out if isinstance(out, DataType) else out(kind)
            return Bound(f"{what}({x.name}, {y.name})", to, x.nullable or y.nullable if nullable is None else nullable(x.nullable or y.nullable), result)

        return single(resolve)

    build.__name__ = what
    return build


def always(_: bool) -> bool:
    return True


def never(_: bool) -> bool:
    return False


def evaluation_error(message: str, kind: str) -> Column:
    """Fails the query when evaluated."""
    return F.raise_error(F.lit(f"ERROR_EVALUATION_ERROR: {message}")).cast(kind)
