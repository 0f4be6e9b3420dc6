"""Sharding as a two-pass external shuffle, in the JVM only.

The id and the number of shards decide the shard: the highest of one hash per shard
wins, so that one more shard takes rows only into itself. A shard has as many buckets
as its own bytes fill, whatever other shards hold. Pass one scatters the whole records:
a seeded hash of id, text and place in the input (so that repeated rows part, too) names
each one's bucket, and they are written with it. Pass two brings each bucket into a task
of its own, sorts it by that hash, shuffles it in memory (Spark's ``shuffle`` is a
Fisher-Yates shuffle; its stream belongs to the task's number, which is the bucket's)
and numbers its rows after those of the shard's buckets before it, so slots have no gaps
and do not depend on the session's partitions. A bucket's offset comes to its task as
one more row, so that records are shuffled once.

Defined results: a null text counts as empty; rows with a null id share a shard, which
gets as many buckets as it needs; an empty table gives an empty result. Bucket by bucket
a task holds about ``bucket_bytes``, or one record if that is larger. Places are those of
the input as it is scanned: files that are split otherwise give other slots, never other
shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from ._common import fresh, read

ROW_BYTES = 16
BUCKET_BYTES = 16 << 20


def _draw(id_col: Column, shard: int, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), F.lit(shard), id_col).alias("h"), F.lit(shard).alias("s"))


def shard_of(id_col: Column, n_shards: int, seed: int) -> Column:
    return F.array_max(F.array(*(_draw(id_col, k, seed) for k in range(n_shards))))


def _scattered(df: DataFrame, n_shards: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``payload`` (all columns), ``size``, ``scatter``, ``shard``, ``grown_shard``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("payload"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.xxhash64(F.lit(seed + 1), F.col(id_col), text, F.monotonically_increasing_id()).alias("scatter"),
        shard_of(F.col(id_col), n_shards, seed).alias("draw"),
        _draw(F.col(id_col), n_shards, seed).alias("more"),
    )
    grown = F.when(F.col("more") > F.col("draw"), F.col("more.s")).otherwise(F.col("draw.s"))
    return drawn.select("payload", "size", "scatter", F.col("draw.s").alias("shard"), grown.alias("grown_shard"))


def shard(df: DataFrame, n_shards: int = 40, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``payload`` (a struct of all columns), ``size``, ``shard``, ``grown_shard`` (with
    one shard more), ``slot``. A task has one bucket's rows, by slot."""
    with Scratch(df.sparkSession) as scratch:
        records = scratch.keep(_scattered(df, n_shards, seed, id_col, text_col))
        # One line a shard: its buckets are those from first on.
        buckets, first = [0] * n_shards, [0] * n_shards
        for r in records.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
            buckets[r["shard"]] = -(-r["bytes"] // bucket_bytes)
        for k in range(1, n_shards):
            first[k] = first[k - 1] + buckets[k - 1]
        total = max(1, sum(buckets))
        of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("shard") + 1)
        dealt = records.withColumn("bucket", (of(first) + F.pmod("scatter", of(buckets))).cast("int"))
        before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = scratch.keep(dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
        scratch.returned(records, offsets)
    row = F.struct("size", "grown_shard", "payload").alias("row")
    rows = dealt.select("bucket", "shard", "scatter", row, F.lit(None).cast("long").alias("before"))
    heads = offsets.select("bucket", "shard", F.lit(None).cast("long").alias("scatter"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "before")
    return (
        rows.unionByName(heads)
        .repartitionById(total, "bucket")
        .sortWithinPartitions("scatter")
        .groupBy("bucket")
        .agg(F.first("shard").alias("shard"), F.max("before").alias("before"), F.collect_list("row").alias("rows"))
        .select("shard", "before", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
        .select("row.payload", "row.size", "shard", "row.grown_shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 40, **options) -> None:
    """Write ``df`` as Parquet, one folder a shard, from pass two as it is: each bucket is
    a file of consecutive slots, in order."""
    out = shard(df, n_shards, **options)
    (name,) = fresh(df, "shard")
    rows = out.select("payload.*", F.col("shard").alias(name), F.col("slot").alias(f"{name}_slot"))
    rows.sortWithinPartitions(name, f"{name}_slot").drop(f"{name}_slot").write.partitionBy(name).parquet(path)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, whole documents going through both passes."""
    out = shard(read(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("payload.text"), F.lit(""))).alias("text_crc32")
    return out.select("payload.doc_id", "size", crc, F.lit("key").alias("law"), "shard", "slot", "grown_shard")
