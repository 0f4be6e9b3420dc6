"""Grouped, scalar and clustered aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import fail
from ..functions.core import Bound, attribute_column
from ..functions.strings import text_of
from ..types import BINARY, BOOL, DATE, DATETIME, ENUM, INT64, INTEGERS, NUMERIC, STRING, DataType, Schema, fit, schema_of
from .ordinals import PART, PLACE, _changed, numbered_segments, parted, refuse_reserved

#: More limited keys than this are joined as Spark sees fit.
MOST_BROADCAST_KEYS = 10_000
SUM, MIN, MAX, COUNT, CONCAT, FIRST, LAST = "SUM", "MIN", "MAX", "COUNT", "CONCAT", "FIRST", "LAST"


@dataclass
class Aggregation:
    function: str
    input: str
    output: str
    distinct: bool = False
    output_type: DataType | None = None


@dataclass
class AggregationSpecification:
    parts: list[Aggregation] = field(default_factory=list)

    def add(self, function: str, input: str, output: str, output_type: DataType | None = None) -> AggregationSpecification:
        self.parts.append(Aggregation(function, input, output, False, output_type))
        return self

    def add_distinct(self, function: str, input: str, output: str, output_type: DataType | None = None) -> AggregationSpecification:
        self.parts.append(Aggregation(function, input, output, True, output_type))
        return self


def _sum(x: Column, a, to: DataType, distinct: bool) -> Column:
    total = F.sum_distinct if distinct else F.sum
    if to not in INTEGERS:
        return total(x.cast("double")).cast(to.spark)
    # Wraps like the output type; 38 digits hold any sum before that.
    wide = x.cast("bigint") if a.type in INTEGERS and to.spark in ("int",) and a.type.spark == "int" else x.cast("decimal(20,0)")
    return fit(total(wide), to)


def _ordered(order: list[Column] | None, what: str) -> Column:
    if not order:
        fail("ERROR_INVALID_ARGUMENT_VALUE", f"{what} depends on the order of rows; give order_by")
    return F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))


def _aggregate(part: Aggregation, schema: Schema, order: list[Column] | None) -> tuple[Bound, Column]:
    """(what comes out, the aggregate)."""
    f, to = part.function, part.output_type
    if not part.input:
        if f != COUNT or part.distinct:
            fail("ERROR_ATTRIBUTE_MISSING", f"{f} needs an input column")
        return Bound(part.output, to or INT64, False, F.col(part.output)), F.count("*").cast((to or INT64).spark)
    a = schema[part.input]
    x = attribute_column(a).col
    if part.distinct and a.type in (BINARY, ENUM):
        fail("ERROR_INVALID_ARGUMENT_TYPE", f"{a.type.name} has no distinct aggregates")
    if f == COUNT:
        to = to or INT64
        if to not in INTEGERS:
            fail("ERROR_INVALID_ARGUMENT_TYPE", "COUNT gives integers")
        return Bound(part.output, to, False, F.col(part.output)), (F.count_distinct(x) if part.distinct else F.count(x)).cast(to.spark)
    if f == SUM:
        to = to or a.type
        if a.type not in NUMERIC or to not in NUMERIC:
            fail("ERROR_INVALID_ARGUMENT_TYPE", f"SUM does not take {a.type.name} to {to.name}")
        col = _sum(x, a, to, part.distinct)
    elif f in (MIN, MAX):
        to = to or a.type
        if to != a.type or a.type not in NUMERIC | {BOOL, DATE, DATETIME, STRING}:
            fail("ERROR_INVALID_ARGUMENT_TYPE", f"{f} does not take {a.type.name} to {to.name}")
        col = F.min(x) if f == MIN else F.max(x)
    elif f == CONCAT:
        to = STRING
        if a.type in (BINARY, ENUM):
            fail("ERROR_INVALID_ARGUMENT_TYPE", f"CONCAT does not take {a.type.name}")
        place = _ordered(order, CONCAT)
        text = text_of(attribute_column(a))
        if part.distinct:  # each value where it first stands
            seen = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(place.alias("o"), text.alias("t")))))
            col = F.array_join(F.array_distinct(F.transform(seen, lambda e: e["t"])), ",")
        else:
            seen = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(place.alias("o"), text.alias("t")))))
            col = F.array_join(F.transform(seen, lambda e: e["t"]), ",")
        col = F.when(F.count(x) > 0, col)
    elif f in (FIRST, LAST):
        to = to or a.type
        place = F.when(x.isNotNull(), _ordered(order, f))
        col = (F.min_by if f == FIRST else F.max_by)(x, place)
    else:
        fail("ERROR_INVALID_ARGUMENT_VALUE", f"no aggregate {f}")
    return Bound(part.output, to, True, F.col(part.output), a.enum), col


def _bind(df: DataFrame, keys: list[str], spec: AggregationSpecification, order):
    schema = schema_of(df)
    refuse_reserved(*df.columns, *(p.output for p in spec.parts))
    key_attributes = [schema[k] for k in keys]
    made = [_aggregate(p, schema, order) for p in spec.parts]
    Schema([*key_attributes, *(b.attribute() for b, _ in made)])
    return key_attributes, made


def _named(made) -> list[Column]:
    return [col.alias(b.name, metadata=b.attribute().metadata()) for b, col in made]


def group_aggregate(df: DataFrame, keys: list[str], spec: AggregationSpecification, order_by: list[Column] | None = None, max_unique_keys: int | None = None) -> DataFrame:
    """Keys, then aggregates. Without keys there is a row only if the input has one.

    With ``max_unique_keys`` K, the K keys that come first in ``order_by`` have their
    own groups; all later keys share one more, under the key that comes next.
    """
    _, made = _bind(df, keys, spec, order_by)
    if not made:
        return df.select(*keys).distinct()
    if not keys:
        return df.agg(*_named(made), F.count("*").alias("__skeinwork_n")).filter("__skeinwork_n > 0").drop("__skeinwork_n")
    if max_unique_keys is not None:
        df = _limited(df, keys, max_unique_keys, order_by)
    return df.groupBy(*keys).agg(*_named(made))


def _limited(df: DataFrame, keys: list[str], most: int, order) -> DataFrame:
    """Rows of the keys beyond the first ``most`` get the key after these. Only
    ``most + 1`` keys are gathered."""
    place = _ordered(order, "max_unique_keys")
    first = df.groupBy(*keys).agg(F.min(place).alias("__skeinwork_first")).orderBy("__skeinwork_first").limit(most + 1)
    kept = first.select(*(F.col(k).alias(f"__skeinwork_k{i}") for i, k in enumerate(keys)), "__skeinwork_first")
    last = first.orderBy(F.col("__skeinwork_first").desc()).limit(1).select(F.struct(*keys).alias("__skeinwork_other"), F.col("__skeinwork_first").alias("__skeinwork_last"))
    on = [F.col(k).eqNullSafe(F.col(f"__skeinwork_k{i}")) for i, k in enumerate(keys)]
    # Both tables have at most most + 1 rows, one of them always a single row. The other
    # is broadcast by hint only while the caller's number keeps it small.
    small = F.broadcast(kept) if most <= MOST_BROADCAST_KEYS else kept
    joined = df.join(small, on, "left").join(F.broadcast(last), F.lit(True), "left")
    return joined.withColumns({k: F.when(F.col("__skeinwork_first").isNotNull(), F.col(k)).otherwise(F.col(f"__skeinwork_other.{k}")) for k in keys}).drop("__skeinwork_other", "__skeinwork_last", "__skeinwork_first", *(f"__skeinwork_k{i}" for i in range(len(keys))))


def best_effort_group_aggregate(df: DataFrame, keys: list[str], spec: AggregationSpecification, order_by: list[Column] | None = None) -> DataFrame:
    """Groups that are complete as far as one task of the input sees them: a key may come
    out once a task, and no key, however frequent, gathers rows of all tasks. For callers
    that merge such rows again; FIRST, LAST and CONCAT are by ``order_by`` within a task."""
    if not keys:
        return group_aggregate(df, keys, spec, order_by)
    _, made = _bind(df, keys, spec, order_by)
    tagged = df.withColumn("__skeinwork_task", F.spark_partition_id())
    named = [F.col(f"`{k}`") for k in keys]
    if not made:
        return tagged.dropDuplicates(["__skeinwork_task", *keys]).select(*named)
    return tagged.groupBy("__skeinwork_task", *named).agg(*_named(made)).drop("__skeinwork_task")


def hybrid_group_aggregate(df: DataFrame, keys: list[str], spec: AggregationSpecification, order_by: list[Column] | None = None) -> DataFrame:
    """Complete groups whatever their number: Spark aggregates in part before the
    shuffle, and sorts and spills where hash tables outgrow their memory, so a quota and
    a temporary folder are settings of the session and not arguments. Plain and DISTINCT
    aggregates may be mixed."""
    return group_aggregate(df, keys, spec, order_by)


def scalar_aggregate(df: DataFrame, spec: AggregationSpecification, order_by: list[Column] | None = None) -> DataFrame:
    """Always one row."""
    _, made = _bind(df, [], spec, order_by)
    return df.agg(*_named(made))


def aggregate_clusters(df: DataFrame, keys: list[str], spec: AggregationSpecification, order_by: list[Column]) -> DataFrame:
    """One row for each run of neighbouring rows with equal keys, in input order
    (column ``__skeinwork_cluster`` of the plan orders them; it is not returned)."""
    if not keys:
        return group_aggregate(df, keys, spec, order_by)
    _, made = _bind(df, keys, spec, order_by)
    rows = _changed(parted(df, order_by), F.struct(*keys), "__skeinwork_starts")
    clusters = numbered_segments(rows, F.col("__skeinwork_starts"), "__skeinwork_cluster").drop(PART, PLACE, "__skeinwork_starts")
    return clusters.groupBy("__skeinwork_cluster", *keys).agg(*_named(made)).drop("__skeinwork_cluster")


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()
