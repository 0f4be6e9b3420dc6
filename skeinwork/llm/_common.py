"""What the training-data operators share: words, bytes and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import freeing_shuffles

#: A word is a run of anything but space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes of an Arrow batch, that a Python worker turns into objects at a
#: time. Bounds memory only: a single longer row is a slice of its own.
SLICE_ROWS = 1000
SLICE_BYTES = 4 << 20


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Number of words, in the JVM; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column, else its mean share."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), column.nbytes // max(1, len(column)), dtype=np.int64)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_ROWS rows and, but for single rows, of
    about SLICE_BYTES bytes."""
    upto = np.cumsum(sum((_sizes(c) for c in batch.columns), np.zeros(batch.num_rows, dtype=np.int64)))
    lo = 0
    while lo < batch.num_rows:
        full = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE_BYTES, side="right"))
        hi = min(lo + SLICE_ROWS, max(full, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_batches(df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[dict], dict]], reads: list[str] | None = None) -> DataFrame:
    """Run a per-batch function over Arrow batches.

    ``make()`` is called once a task and returns the function from a dict of Python
    lists (of the columns that it ``reads``, else of all) to a dict of lists or arrays of
    the same length. Columns that it does not return pass through as they are.
    """
    names = [f.name for f in schema.fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or make()
            for part in slices(batch):
                own = dict(zip(part.schema.names, part.columns))
                out = work({n: c.to_pylist() for n, c in own.items() if reads is None or n in reads})
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) if n in out else own[n].cast(arrow.field(n).type) for n in names], names=names)

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, one for each wanted."""
    have = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


# --------------------------------------------------------------------------
# look-ups by keys of which a few may be very frequent

#: Keys that hold more than this share of the rows (and more than LIGHT rows) are heavy.
MOST_HEAVY = 4096
LIGHT = 64


def heavy_keys(counted: DataFrame, key: str, n_rows: int) -> list[int]:
    """From one line a key with the number ``n`` of its rows: the keys that hold more
    than 1 / MOST_HEAVY of all ``n_rows`` rows. Whatever the data, there are no more
    than about MOST_HEAVY of them, so the driver may know them and plans name them."""
    with freeing_shuffles(counted.sparkSession):
        return [r[0] for r in counted.filter(F.col("n") > max(LIGHT, n_rows // MOST_HEAVY)).select(key).collect()]


def looked_up(rows: DataFrame, key: str, table: DataFrame, heavy: list[int]) -> DataFrame:
    """Inner join with ``table``, which holds each key once. Rows of heavy keys stay
    where they are and meet the broadcast lines of these; the others are shuffled, and
    no key among them is large."""
    if not heavy:
        return rows.join(table, key)
    is_heavy = F.col(key).isin(heavy)
    hot = rows.filter(is_heavy).join(F.broadcast(table.filter(is_heavy)), key)
    return hot.unionByName(rows.filter(~is_heavy).join(table.filter(~is_heavy), key))
