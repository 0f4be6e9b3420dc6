"""Equi-joins, the row-number join and the foreign filter."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import fail
from ..functions.core import Bound, Expr, bound_select
from ..types import INT64, Schema, schema_of
from .ordinals import with_ordinal

INNER, LEFT_OUTER, RIGHT_OUTER, FULL_OUTER = "inner", "left", "right", "full"
NOT_UNIQUE, UNIQUE = "not_unique", "unique"


@dataclass
class CompoundMultiSourceProjector:
    """Which columns of which input come out, in order."""

    parts: list[tuple[int, Expr]] = field(default_factory=list)

    def add(self, source: int, projector: Expr) -> CompoundMultiSourceProjector:
        self.parts.append((source, projector))
        return self


_SIDES = ("l", "r")


def _prefixed(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{side}.{c}") for c in df.columns))



def _keys(df: DataFrame, selector: Expr) -> list[Bound]:
    return selector.bind(schema_of(df))


def _projected(joined: DataFrame, projector: CompoundMultiSourceProjector, schemas: list[Schema], outer: bool) -> DataFrame:
    out = []
    for source, p in projector.parts:
        side = _SIDES[source]
        # Projectors pick and rename; resolve against the side, then point at its prefixed columns.
        for b in p.bind(schemas[source]):
            origin = next(a.name for a in schemas[source] if _same_column(b, a.name))
            out.append(Bound(b.name, b.type, b.nullable or (outer and source == 1), F.col(f"`{side}.{origin}`"), b.enum))
    return bound_select(joined, out)


def _same_column(b: Bound, name: str) -> bool:
    return b.col._jc.toString() == F.col(f"`{name}`")._jc.toString()


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, by an aggregate that combines
    before the shuffle; a hot key is no burden to one task."""
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.min_by(F.struct(*(F.col(f"`{c}`").alias(c) for c in rest), F.lit(0).alias("__")), place).alias("__skeinwork_row"))
    return kept.select(*(F.col(f"`{c}`") if c in keys else F.col(f"__skeinwork_row.`{c}`").alias(c) for c in df.columns))


def hash_join(
    left: DataFrame,
    right: DataFrame,
    join_type: str,
    left_key: Expr,
    right_key: Expr,
    projector: CompoundMultiSourceProjector,
    uniqueness: str = NOT_UNIQUE,
    right_order: list[Column] | None = None,
) -> DataFrame:
    """Rows with equal keys; a null key meets nothing. ``UNIQUE`` keeps the first row
    of a repeated right key, which takes ``right_order``; without that, the promise
    is trusted. Spark picks the strategy by the sides' sizes."""
    if join_type not in (INNER, LEFT_OUTER):
        fail("ERROR_NOT_IMPLEMENTED", f"{join_type} joins are not supported")
    lk, rk = _keys(left, left_key), _keys(right, right_key)
    if len(lk) != len(rk):
        fail("ERROR_ATTRIBUTE_COUNT_MISMATCH", "the sides' keys differ in length")
    for a, b in zip(lk, rk):
        if a.type != b.type:
            fail("ERROR_ATTRIBUTE_TYPE_MISMATCH", f"{a.name} is {a.type.name}, {b.name} is {b.type.name}")
    schemas = [schema_of(left), schema_of(right)]
    if uniqueness == UNIQUE and right_order:
        right = first_by_key(right, [b.name for b in rk], right_order)
    l, r = _prefixed(left, "l"), _prefixed(right, "r")
    on = reduce(Column.__and__, (F.col(f"`l.{a.name}`") == F.col(f"`r.{b.name}`") for a, b in zip(lk, rk)))
    return _projected(l.join(r, on, join_type), projector, schemas, join_type == LEFT_OUTER)


def rowid_merge_join(left: DataFrame, left_key: str, right: DataFrame, right_order: list[Column], projector: CompoundMultiSourceProjector) -> DataFrame:
    """Left rows with the right row whose 0-based number their key names. A key
    beyond the right side fails the query."""
    schemas = [schema_of(left), schema_of(right)]
    if schemas[0][left_key].type != INT64:
        fail("ERROR_ATTRIBUTE_TYPE_MISMATCH", f"{left_key} must be INT64")
    numbered = with_ordinal(right, right_order, "__skeinwork_row_id")
    l, r = _prefixed(left, "l"), _prefixed(numbered, "r")
    joined = l.join(r, F.col(f"`l.{left_key}`") == F.col("`r.__skeinwork_row_id`"), "left")
    dangling = F.raise_error(F.concat(F.lit("ERROR_FOREIGN_KEY_INVALID: no row "), F.col(f"`l.{left_key}`").cast("string"))).cast("boolean")
    checked = joined.filter(F.when(F.col("`r.__skeinwork_row_id`").isNotNull(), True).otherwise(dangling))
    return _projected(checked, projector, schemas, False)


def foreign_filter(filter_df: DataFrame, filter_key: str, foreign_key: str, input_df: DataFrame) -> DataFrame:
    """Input rows whose foreign key is among the filter's unique keys; the key is
    replaced by its place among them."""
    fk, ik = schema_of(filter_df)[filter_key], schema_of(input_df)[foreign_key]
    if fk.type != INT64 or ik.type != INT64:
        fail("ERROR_ATTRIBUTE_TYPE_MISMATCH", "filter and foreign key must be INT64")
    places = with_ordinal(filter_df.select(filter_key), [F.col(filter_key)], "__skeinwork_place").withColumnRenamed(filter_key, "__skeinwork_key")
    joined = input_df.join(places, input_df[foreign_key] == places["__skeinwork_key"])
    return joined.select(*(F.col("__skeinwork_place").alias(c) if c == foreign_key else input_df[c] for c in input_df.columns))


def scan_with_selection(df: DataFrame, order: list[Column], row_ids: DataFrame, position: str = "position", row_id: str = "row_id") -> DataFrame:
    """The rows that ``row_ids`` names, as often as it names them, by its positions."""
    numbered = with_ordinal(df, order, "__skeinwork_row_id")
    return row_ids.join(numbered, row_ids[row_id] == numbered["__skeinwork_row_id"]).orderBy(row_ids[position]).select(*(numbered[c] for c in df.columns))


