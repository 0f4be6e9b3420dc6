"""Project, compute, filter, sort, limit and the operators that align rows.

Every operator takes DataFrames and returns one. Where the result depends on the order
of rows, the order is an argument. Operators that number rows (and those built on
numbers: zips, permutations, row-number joins, running functions, clusters) sort and
keep their input when the plan is built; all others are lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import fail
from ..functions.core import Expr, bound_select, resolve_on, want
from ..functions.strings import upper_ascii
from ..session import durable
from ..types import BOOL, Schema, schema_of
from .ordinals import with_ordinal

ASCENDING, DESCENDING = "asc", "desc"


def project(df: DataFrame, projector: Expr) -> DataFrame:
    return bound_select(df, resolve_on(df, projector))


#: The result has the expression's columns only.
compute = project


def filter_rows(df: DataFrame, predicate: Expr, projector: Expr | None = None) -> DataFrame:
    """Rows for which the predicate is true, then the projection."""
    p = want(predicate.one(schema_of(df)), {BOOL}, "FILTER")
    kept = df.filter(p.col)
    return kept if projector is None else project(kept, projector)


# --------------------------------------------------------------------------
# order


@dataclass
class SortOrder:
    """Columns with directions; nulls are smaller than all else."""

    keys: list[tuple[Expr, str]] = field(default_factory=list)

    def add(self, projector: Expr, direction: str = ASCENDING) -> SortOrder:
        self.keys.append((projector, direction))
        return self

    def columns(self, df: DataFrame) -> list[Column]:
        out = []
        for projector, direction in self.keys:
            for b in resolve_on(df, projector):
                out.append(b.col.asc_nulls_first() if direction == ASCENDING else b.col.desc_nulls_last())
        return out


def sort(df: DataFrame, order: SortOrder, projector: Expr | None = None) -> DataFrame:
    out = df.orderBy(*order.columns(df))
    return out if projector is None else project(out, projector)


@dataclass
class ExtendedSortSpecification:
    """Named keys, each with or without regard to case, and a limit."""

    keys: list[tuple[str, str, bool]] = field(default_factory=list)
    limit: int | None = None

    def add(self, name: str, direction: str = ASCENDING, case_sensitive: bool = True) -> ExtendedSortSpecification:
        self.keys.append((name, direction, case_sensitive))
        return self

    def set_limit(self, limit: int) -> ExtendedSortSpecification:
        self.limit = limit
        return self


def extended_sort(df: DataFrame, spec: ExtendedSortSpecification, projector: Expr | None = None) -> DataFrame:
    """With a limit, Spark keeps only that many rows a task (a top-k, no full sort)."""
    names = [k[0] for k in spec.keys]
    if len(set(names)) < len(names):
        fail("ERROR_ATTRIBUTE_EXISTS", f"sort keys repeat: {names}")
    schema, order = schema_of(df), []
    for name, direction, case_sensitive in spec.keys:
        schema[name]
        key = F.col(f"`{name}`") if case_sensitive else upper_ascii(F.col(f"`{name}`"))
        order.append(key.asc_nulls_first() if direction == ASCENDING else key.desc_nulls_last())
    out = df.orderBy(*order)
    if spec.limit is not None:
        out = out.limit(spec.limit)
    return out if projector is None else project(out, projector)


def sort_permutation(df: DataFrame, order: SortOrder, input_order: list[Column]) -> DataFrame:
    """``position`` and ``row_id``: which input row comes at each place of the order.
    Only the columns of the two orders are sorted and kept."""
    values = [b.col.alias(f"key{i}") for i, b in enumerate(b for projector, _ in order.keys for b in resolve_on(df, projector))]
    directions = [d for projector, d in order.keys for _ in resolve_on(df, projector)]
    numbered = with_ordinal(df, input_order, "row_id", values)
    by = [F.col(f"key{i}").asc_nulls_first() if d == ASCENDING else F.col(f"key{i}").desc_nulls_last() for i, d in enumerate(directions)]
    return with_ordinal(numbered, [*by, F.col("row_id")], "position").select("position", "row_id")


def limit(df: DataFrame, offset: int, count: int, order_by: list[Column]) -> DataFrame:
    return df.orderBy(*order_by).offset(offset).limit(count)


# --------------------------------------------------------------------------
# several inputs


def merge_union_all(inputs: list[DataFrame], order: SortOrder) -> DataFrame:
    """All rows of all inputs in order; types must agree, column by column."""
    if not inputs:
        fail("ERROR_ATTRIBUTE_COUNT_MISMATCH", "an empty union needs a session; use an empty DataFrame")
    first = schema_of(inputs[0])
    for df in inputs[1:]:
        other = schema_of(df)
        if [a.type for a in other] != [a.type for a in first]:
            fail("ERROR_ATTRIBUTE_TYPE_MISMATCH", "inputs of a union differ in types")
    out = reduce(DataFrame.unionAll, inputs)
    return out.orderBy(*order.columns(out))


def coalesce(inputs: list[tuple[DataFrame, list[Column]]]) -> DataFrame:
    """Columns of the inputs side by side, row by row in each one's order, as far as
    the shortest goes."""
    if len(inputs) == 1:
        return inputs[0][0]
    Schema([a for df, _ in inputs for a in schema_of(df)])  # names must differ
    numbered = [with_ordinal(df, order, "__skeinwork_ordinal") for df, order in inputs]
    return reduce(lambda a, b: a.join(b, "__skeinwork_ordinal"), numbered).drop("__skeinwork_ordinal")


def split(df: DataFrame, readers: int) -> list[DataFrame]:
    """One input for several readers: computed once and kept on shared storage, so that
    a lost executor takes nothing with it; Spark drops it with the last reader."""
    return [durable(df)] * readers
