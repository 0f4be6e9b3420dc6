"""Exact top-k inner-product search with a ball tree per shard.

Vectors go to shards by a hash; a shard is as large as one task holds easily. Each
shard's tree splits its vectors in half along their widest direction down to
small leaves; a node knows its centre and radius. Queries stream past it. A query
visits nodes by their upper bound, centre product plus norm times radius, and stops
where no node can beat its current k-th score.

Shards are searched in waves, each WAVE times the one before. After a wave every
query's k-th score over all shards so far is its floor in the next, so that the score
shared is the current one. A wave's task holds one shard and a batch of queries; every
query is sent once to every shard.

Components are whole numbers, floor(256 * x); scores are exact, whatever their size:
bounds and first scores are doubles with a margin for their rounding, and where
doubles do not hold a score exactly, what passes is scored in whole numbers.

Defined results: vectors that are null or hold a null or a non-finite component
take no part; vectors of different lengths have no product and do not meet; ids
may repeat, each row is a candidate and only a query's own row is none of its
candidates; null ids are neither queries nor results; ties go to the smaller id; a
score beyond a long's range counts, and is given, as the nearest long; vectors without
components have a score of 0; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from ._common import read

SHARD_ROWS = 8192
LEAF_ROWS = 64
WAVE = 4
#: Relative margin of bounds, far above the rounding of products of any usual length.
MARGIN = 1e-9
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole(x: np.ndarray) -> tuple[np.ndarray, int]:
    """floor(256 * x) as ``y * 2**e`` with doubles y; e is 0 where squares and sums of
    them hold as they are."""
    most = float(np.abs(x).max(initial=0.0))
    e = 0 if most < 2.0**400 else math.frexp(most)[1]
    small = np.abs(x) < 2.0**44  # beyond, 256 * x is whole
    y = np.ldexp(x, 8 - e)
    y[small] = np.ldexp(np.floor(x[small] * 256), -e)
    return y, e


def _integers(x: np.ndarray) -> list[int]:
    return [math.floor(c * 256) if abs(c) < 2.0**60 else int(c) * 256 for c in x.tolist()]


class BallTree:
    """Nodes with centre, radius and row range over the rows of ``x``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, uids: np.ndarray):
        self.x, self.ids, self.uids = x, ids, uids
        self.v, self.e = whole(x)
        self.most = float(np.abs(self.v).max(initial=0.0))
        self.norms = np.sqrt((self.v * self.v).sum(axis=1))
        self.order = np.arange(len(x))
        self.centre, self.radius, self.reach, self.span, self.kids = [], [], [], [], []
        self.visited = 0
        self._build(0, len(x))

    def _build(self, lo: int, hi: int) -> int:
        rows = self.v[self.order[lo:hi]]
        centre = rows.mean(axis=0)
        node = len(self.centre)
        self.centre.append(centre)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        self.radius.append(radius)
        self.reach.append(float(np.sqrt((centre * centre).sum())) + radius)
        self.span.append((lo, hi))
        self.kids.append(None)
        if hi - lo > LEAF_ROWS and rows.shape[1]:
            spread = np.ptp(rows, axis=0)
            if spread.max() > 0:
                mid = (hi - lo) // 2
                part = np.argpartition(rows[:, spread.argmax()], mid)
                self.order[lo:hi] = self.order[lo:hi][part]
                self.kids[node] = (self._build(lo, lo + mid), self._build(lo + mid, hi))
        return node

    def search(self, x: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The best k (score, -id) with scores of at least ``floor``."""
        q, e = whole(x)
        e += self.e
        norm = float(np.sqrt((q * q).sum()))
        exact = e == 0 and len(q) * self.most * float(np.abs(q).max(initial=0.0)) < 2.0**53
        numbers = None if exact else _integers(x)
        bound = lambda n: float(q @ self.centre[n]) + norm * (self.radius[n] + MARGIN * self.reach[n])
        best: list[tuple[int, int]] = []
        limit = -math.inf if floor is None else self._scaled(floor, e)
        queue = [(-bound(0), 0)]
        while queue and -queue[0][0] >= limit:
            _, node = heapq.heappop(queue)
            self.visited += 1
            if self.kids[node]:
                for kid in self.kids[node]:
                    if (b := bound(kid)) >= limit:
                        heapq.heappush(queue, (-b, kid))
                continue
            rows = self.order[slice(*self.span[node])]
            scores = self.v[rows] @ q
            near = scores >= limit if exact else scores + MARGIN * norm * self.norms[rows] >= limit
            for r, score in zip(rows[near].tolist(), scores[near].tolist()):
                if self.uids[r] == own:
                    continue
                score = int(score) if exact else min(_MOST, max(_LEAST, sum(a * b for a, b in zip(_integers(self.x[r]), numbers))))
                item = (score, -int(self.ids[r]))
                if (floor is None or score >= floor) and (len(best) < k or item > best[0]):
                    (heapq.heappush if len(best) < k else heapq.heapreplace)(best, item)
                    if len(best) == k:
                        limit = max(limit, self._scaled(best[0][0], e))
        return best

    @staticmethod
    def _scaled(score: int, e: int) -> float:
        """``score * 2**-e``, rounded down; the least long stands for all below it, too."""
        if score == _LEAST:
            return -math.inf
        return math.nextafter(math.ldexp(float(score), -e), -math.inf) if e or abs(score) >= 2**53 else float(score)


def _search(rows: DataFrame, k: int) -> DataFrame:
    """From rows sorted by ``d``, ``shard`` and ``asks``: what each query finds in each
    shard, at most k lines."""

    def run(batches):
        tree, group, held = None, None, []
        for batch in batches:
            d, shard, asks = (batch.column(c).to_numpy() if c != "asks" else batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "shard", "asks"))
            where = np.stack([d, shard, asks])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            out: list[tuple] = []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, d[lo])
                uid, vec_id = part.column("uid").to_numpy(), part.column("vec_id").to_numpy()
                if group != (d[lo], shard[lo]):
                    tree, group, held = None, (d[lo], shard[lo]), []
                if not asks[lo]:
                    held.append((x, vec_id, uid))
                    continue
                if held:
                    tree, held = BallTree(*map(np.concatenate, zip(*held))), []
                if tree is not None:
                    for own, i, q, floor in zip(uid.tolist(), vec_id.tolist(), x, part.column("floor").to_pylist()):
                        out += [(own, i, -found, score) for score, found in tree.search(q, own, k, floor)]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], names=["quid", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "quid long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query row's best k."""
    vector, vec_id = F.col(vector_col), F.col(id_col)
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    taking_part = df.filter(vec_id.isNotNull() & vector.isNotNull() & finite)
    with Scratch(df.sparkSession) as scratch:
        ready = scratch.keep(
            taking_part.select(vec_id.cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.size(vector).alias("d"))
            .withColumn("uid", F.monotonically_increasing_id())
        )
        shards = max(1, -(-ready.count() // shard_rows))
        vectors = ready.withColumn("asks", F.lit(False)).withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
        best, floors, lo, size = None, None, 0, 1
        while lo < shards:
            hi = min(shards, lo + size)
            asked = ready.filter("asks")
            asked = asked.withColumn("floor", F.lit(None).cast("long")) if floors is None else asked.join(floors, "uid", "left")
            sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
            held = vectors.filter(F.col("shard").between(lo, hi - 1)).withColumn("floor", F.lit(None).cast("long"))
            both = held.unionByName(sent).select("d", "shard", "asks", "uid", "vec_id", "floor", "vector")
            # One task a shard; its vectors come before its queries.
            dealt = both.repartitionById(hi - lo, (F.col("shard") - lo).cast("int")).sortWithinPartitions("d", "shard", "asks")
            found = scratch.keep(_search(dealt, k))
            last = best
            best = scratch.keep(_best(found if last is None else last.unionByName(found), k).drop("rank"))
            scratch.drop(found, *([last] if last is not None else []))
            floors = best.groupBy(F.col("quid").alias("uid")).agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k).drop("n")
            lo, size = hi, size * WAVE
        scratch.returned(best)
    return _best(best, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The five best of all other rows for every fiftieth id."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM parts q JOIN parts c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
