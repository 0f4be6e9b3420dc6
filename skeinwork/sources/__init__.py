"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import fail
from ..functions.core import attribute_column
from ..functions.strings import text_of
from ..types import Schema, schema_of


def generate(spark: SparkSession, count: int) -> DataFrame:
    """``count`` rows without columns."""
    if count < 0:
        fail("ERROR_INVALID_ARGUMENT_VALUE", "a count is not negative")
    return spark.range(count).select()


class Table:
    """An in-memory table that grows by rows and can be scanned."""

    def __init__(self, spark: SparkSession, schema: Schema):
        self.spark, self.schema = spark, schema
        self.rows: list[tuple] = []

    def append(self, *values) -> Table:
        if len(values) != len(self.schema):
            fail("ERROR_ATTRIBUTE_COUNT_MISMATCH", f"{len(values)} values for {len(self.schema)} columns")
        for v, a in zip(values, self.schema):
            if v is None and not a.nullable:
                fail("ERROR_INVALID_ARGUMENT_VALUE", f"{a.name} takes no null")
        self.rows.append(values)
        return self

    def scan(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, self.schema.spark())


def scan_view(df: DataFrame) -> DataFrame:
    return df


def file_input(spark: SparkSession, path: str, schema: Schema | None = None) -> DataFrame:
    """A Parquet file or folder; with a schema, only and exactly its columns."""
    reader = spark.read if schema is None else spark.read.schema(schema.spark())
    return reader.parquet(path)


def file_output(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def repeating_block(df: DataFrame, rows: int, order: list) -> DataFrame:
    """The rows again and again, in order, ``rows`` in all."""
    from ..operators.ordinals import with_ordinal

    numbered = with_ordinal(df, order, "__skeinwork_k")
    n = numbered.count()
    if not n:
        fail("ERROR_TOO_FEW_ROWS", "nothing to repeat")
    turns = df.sparkSession.range(rows).select(F.col("id").alias("__skeinwork_id"), (F.col("id") % n).alias("__skeinwork_k"))
    return turns.join(numbered, "__skeinwork_k").orderBy("__skeinwork_id").drop("__skeinwork_k", "__skeinwork_id")


class Sink:
    """A target that takes rows; ``write`` takes a DataFrame, ``finalize`` ends it."""

    def write(self, df: DataFrame) -> int:
        raise NotImplementedError

    def finalize(self) -> None:
        pass


class FileSink(Sink):
    def __init__(self, path: str):
        self.path, self.parts = path, 0

    def write(self, df: DataFrame) -> int:
        df.write.mode("append").parquet(self.path)
        self.parts += 1
        return self.parts


class CallbackSink(Sink):
    def __init__(self, take: Callable[[DataFrame], None]):
        self.take = take

    def write(self, df: DataFrame) -> int:
        self.take(df)
        return 1


class Writer:
    """Drains a DataFrame, whole into a sink or row by row to the caller."""

    def __init__(self, df: DataFrame):
        self.df = df

    def write_all(self, sink: Sink) -> None:
        sink.write(self.df)
        sink.finalize()

    def rows(self) -> Iterator[Row]:
        """One partition at a time."""
        return self.df.toLocalIterator()


def printed(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text, enum values by name, values in their printed form."""
    schema = schema_of(df)
    shown = df.select(*(F.coalesce(text_of(attribute_column(a)), F.lit("NULL")).alias(a.name) for a in schema)).limit(rows)
    head = ", ".join(f"{a.name}: {a.type.name}{'' if a.nullable else ' NOT NULL'}" for a in schema)
    return "\n".join([head, *(", ".join(r) for r in shown.collect())])


