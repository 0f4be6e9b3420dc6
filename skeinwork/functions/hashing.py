"""64-bit hashes with fixed values, over Arrow batches.

The state is multiplied by one prime and joined (exclusive or) with each chunk of
four bytes times another prime; the primes take turns.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import BINARY, BOOL, DATE, DATETIME, DOUBLE, ENUM, FLOAT, FLOATS, INT32, INT64, STRING, UINT32, UINT64, DataType
from .core import Bound, Expr, single, want
from .dates import micros

# The primes next above 2 ** 32.
PRIMES = (
    4294967311, 4294967357, 4294967371, 4294967377, 4294967387, 4294967389, 4294967459, 4294967477,
    4294967497, 4294967513, 4294967539, 4294967543, 4294967549, 4294967561, 4294967563, 4294967569,
)
FINGERPRINT_SEED = 42
_MASK = 2**64 - 1


def hash_bytes(data: bytes, seed: int) -> int:
    state = seed
    for turn, at in enumerate(range(0, len(data), 4)):
        chunk = int.from_bytes(data[at : at + 4], "little")
        state = state * PRIMES[turn % 16] & _MASK ^ chunk * PRIMES[(turn + 8) % 16] & _MASK
    return state


def _carried(b: Bound):
    """The value as bigint or binary."""
    if b.type in (STRING, BINARY):
        return b.col.cast("binary")
    if b.type in FLOATS:
        return b.col
    if b.type == DATETIME:
        return micros(b.col)
    if b.type == DATE:
        return F.unix_date(b.col).cast("bigint")
    if b.type == UINT64:
        return b.col.cast("string")
    return b.col.cast("bigint") if b.type != BOOL else b.col.cast("int").cast("bigint")


def _as_bytes(kind: DataType):
    if kind in (STRING, BINARY):
        return bytes
    if kind == FLOAT:
        return lambda v: struct.pack("<f", v)
    if kind == DOUBLE:
        return lambda v: struct.pack("<d", v)
    return lambda v: (int(v) & _MASK).to_bytes(8, "little")


def _hashed(kind: DataType):
    to_bytes = _as_bytes(kind)

    @F.pandas_udf(T.StringType())
    def udf(values: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or s is None else str(hash_bytes(to_bytes(v), int(s))) for v, s in zip(values.astype(object).where(values.notna(), None), seeds)], dtype=object)

    return udf


def _hash(what: str, e: Expr, seed: Expr, kinds) -> Expr:
    def resolve(s):
        x, k = want(e.one(s), kinds, what), want(seed.one(s), {UINT64}, what)
        value = F.when(x.col.isNotNull(), _hashed(x.type)(_carried(x), k.col.cast("string")))
        return Bound(f"{what}({x.name})", UINT64, x.nullable or k.nullable, value.cast("decimal(20,0)"))

    return single(resolve)


_WHOLE_KINDS = {INT32, INT64, UINT32, UINT64, BOOL, ENUM, DATE, DATETIME, STRING, BINARY}


def Fingerprint(e: Expr) -> Expr:
    from .terminals import ConstUint64

    return _hash("FINGERPRINT", e, ConstUint64(FINGERPRINT_SEED), _WHOLE_KINDS)


def Hash(e: Expr, seed: Expr) -> Expr:
    return _hash("HASH", e, seed, _WHOLE_KINDS | FLOATS)
