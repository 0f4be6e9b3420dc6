"""Row numbers and running functions in a global order, without a single task.

A window over the whole table would put all rows into one task. Here the rows are
range-partitioned by the order and kept; each partition works on its own rows,
and what it needs of those before it (a count, a sum, the last value) comes from a
table with one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import fail
from ..session import durable
from ..types import INTEGERS, NUMERIC, fit, schema_of

#: Helper columns start with this; a caller's own may not.
RESERVED = "__skeinwork_"
PART, PLACE = f"{RESERVED}range", f"{RESERVED}in_range"


def refuse_reserved(*names: str) -> None:
    """Names that start like the operators' helper columns would be overwritten or lost."""
    clash = [n for n in names if n.lower().startswith(RESERVED)]
    if clash:
        fail("ERROR_ATTRIBUTE_EXISTS", f"names that start with {RESERVED} are reserved: {clash}")


def parted(df: DataFrame, order: list[Column], *names: str, needed: list[Column] | None = None) -> DataFrame:
    """The rows with the number of their range and their place in it, kept: this runs
    as soon as the plan is built. ``names`` are columns to be added, ``needed`` all that
    is to be carried."""
    refuse_reserved(*df.columns, *names)
    rows = df.orderBy(*order)
    rows = rows if needed is None else rows.select(*needed)
    return durable(rows.withColumn(PLACE, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(PLACE, 33).cast("int")))


def _within(*keys: str):
    return Window.partitionBy(PART, *keys).orderBy(PLACE)


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def with_ordinal(df: DataFrame, order: list[Column], name: str, needed: list[Column] | None = None) -> DataFrame:
    """A 0-based number for each row, in order; of the columns all, or those needed."""
    rows = parted(df, order, needed=needed)
    starts = rows.groupBy(PART).agg(F.count("*").alias("__skeinwork_n")).select(PART, F.coalesce(F.sum("__skeinwork_n").over(_before()), F.lit(0)).alias("__skeinwork_start"))
    # The id counts up within a partition, from a known number.
    own = F.col(PLACE) - F.shiftleft(F.col(PART).cast("long"), 33)
    return rows.join(F.broadcast(starts), PART).withColumn(name, F.col("__skeinwork_start") + own).drop(PART, PLACE, "__skeinwork_start")


def sequence(df: DataFrame, order: list[Column], name: str = "SEQUENCE") -> DataFrame:
    refuse_reserved(name)
    return with_ordinal(df, order, name)


def _column_type(df: DataFrame, column: str, kinds, what: str):
    a = schema_of(df)[column]
    if a.type not in kinds:
        fail("ERROR_INVALID_ARGUMENT_TYPE", f"{what} does not take {a.type.name}")
    return a


def _with_carry(rows: DataFrame, inside: Column, partial: Column, carried: Column, merge, name: str) -> DataFrame:
    """``inside``: running value within a range; ``partial``: a range's aggregate;
    ``carried``: aggregate of ``__p`` over the ranges before; ``merge`` of both."""
    parts = rows.groupBy(PART).agg(partial.alias("__skeinwork_p")).select(PART, carried.over(_before()).alias("__skeinwork_c"))
    return rows.withColumn("__skeinwork_in", inside).join(F.broadcast(parts), PART).withColumn(name, merge(F.col("__skeinwork_c"), F.col("__skeinwork_in"))).drop("__skeinwork_in", "__skeinwork_c")


def running_sum(df: DataFrame, column: str, order: list[Column], name: str) -> DataFrame:
    """Nulls count for nothing; null until the first value; the type is kept, and
    integers wrap: 38 digits hold any sum before that."""
    kind = _column_type(df, column, NUMERIC, "RUNNING_SUM").type
    w = _within().rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(column).cast("decimal(20,0)") if kind in INTEGERS else F.col(column)
    whole = lambda x: fit(x.cast("decimal(38,0)"), kind) if kind in INTEGERS else x.cast(kind.spark)
    add = lambda a, b: whole(F.coalesce(a + b, a, b))
    return _with_carry(parted(df, order, name), F.sum(value).over(w), F.sum(value), F.sum("__skeinwork_p"), add, name).drop(PART, PLACE)


def smudge(df: DataFrame, column: str, order: list[Column], name: str) -> DataFrame:
    """The last value so far that is not null."""
    w = _within().rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by(column, F.when(F.col(column).isNotNull(), F.col(PLACE)))
    return _with_carry(parted(df, order, name), F.last(column, True).over(w), last, F.last("__skeinwork_p", True), lambda a, b: F.coalesce(b, a), name).drop(PART, PLACE)


def _lagged(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``value`` of the row before, as a struct; null in the first row."""
    inside = F.lag(F.struct(value.alias("v"))).over(_within())
    last = F.max_by(F.struct(value.alias("v")), PLACE)
    return _with_carry(rows, inside, last, F.last("__skeinwork_p", True), lambda a, b: F.coalesce(b, a), name)


def changed(df: DataFrame, column: str, order: list[Column], name: str) -> DataFrame:
    """Whether a row differs from the one before; the first one does."""
    return _changed(parted(df, order, name), F.col(column), name).drop(PART, PLACE)


def _changed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return _lagged(rows, value, "__skeinwork_lag").withColumn(name, F.coalesce(~F.col("__skeinwork_lag.v").eqNullSafe(value), F.lit(True)) | F.col("__skeinwork_lag").isNull()).drop("__skeinwork_lag")


def numbered_segments(rows: DataFrame, starts: Column, name: str) -> DataFrame:
    """The number of rows so far that start a segment."""
    w = _within().rowsBetween(Window.unboundedPreceding, 0)
    one = starts.cast("long")
    return _with_carry(rows, F.sum(one).over(w), F.sum(one), F.sum("__skeinwork_p"), lambda a, b: F.coalesce(a, F.lit(0)) + b, name)


def running_min_with_flush(df: DataFrame, flush: str, column: str, order: list[Column], name: str) -> DataFrame:
    """The least value since the last flush; a row that flushes still sees what was
    before it, the next one does not."""
    _column_type(df, column, INTEGERS, "RUNNING_MIN_WITH_FLUSH")
    rows = _lagged(parted(df, order, name), F.col(flush), "__skeinwork_flushed")
    rows = numbered_segments(rows, F.coalesce(F.col("__skeinwork_flushed.v"), F.lit(False)), "__skeinwork_segment")
    w = _within("__skeinwork_segment").rowsBetween(Window.unboundedPreceding, 0)
    # Only the segment that runs on into a range has anything to carry.
    parts = rows.groupBy("__skeinwork_segment", PART).agg(F.min(column).alias("__skeinwork_p"))
    carried = parts.select("__skeinwork_segment", PART, F.min("__skeinwork_p").over(_before("__skeinwork_segment")).alias("__skeinwork_c"))
    return (
        rows.withColumn("__skeinwork_in", F.min(column).over(w))
        .join(carried, ["__skeinwork_segment", PART])
        .withColumn(name, F.least("__skeinwork_c", "__skeinwork_in"))
        .drop("__skeinwork_in", "__skeinwork_c", "__skeinwork_segment", "__skeinwork_flushed", PART, PLACE)
    )


def smudge_if(df: DataFrame, column: str, condition: str, order: list[Column], name: str) -> DataFrame:
    """Where the condition holds, the previous result again."""
    rows = numbered_segments(parted(df, order, name), ~F.coalesce(F.col(condition), F.lit(False)), "__skeinwork_segment")
    # A segment's value is that of the row that starts it; segment 0 has rows only
    # if the first row's condition holds, and its value is the first row's.
    first = rows.groupBy("__skeinwork_segment").agg(F.min_by(F.struct(F.col(column).alias("v")), PLACE).alias("__skeinwork_first"))
    return rows.join(first, "__skeinwork_segment").withColumn(name, F.col("__skeinwork_first.v")).drop("__skeinwork_first", "__skeinwork_segment", PART, PLACE)
