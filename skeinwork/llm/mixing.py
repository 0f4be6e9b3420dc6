"""Mixing sources to target weights by weighted fair queueing, in the JVM only.

Each source's documents stand in a seeded random order and may be served twice. A
document's virtual finish time is its source's running word count up to and with
it, divided by the source's target; services are range-sorted by that time over all
sources and truncated where the total budget is spent. All sources then run out of
budget at the same time.

Nothing is gathered by source: both orders (a source's random one, the one by virtual
time) are range partitions of the whole table, whose bounds may part rows that agree in
all but their place. Sums of the ranges come first, then running sums within each. What
is sorted in one task is one range; over ranges there is one line each.

Defined results: a null text has no words; a null source is a source of its own,
after all others; rows that agree in id and text are served one by one like any others;
documents without words take nothing; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from ._common import n_words, read


def _weight(place: Column, weights: tuple[float, ...]) -> Column:
    """The weight at a 0-based place, repeating."""
    return F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row a source: ``src``, ``source_size``, ``target``.

    Targets divide ``share`` of all words by weight; one that would pass ``most``
    times its source stays there and the others share the rest. So each target is
    the lesser of its cap and its weight times a common level. With sources by
    rising cap per weight, the level that would hold if all before were capped is
    highest where it is right. A window over all sources runs in one task, which holds a
    line a source.
    """
    sums = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.max("source").alias("source"))
    every = Window.partitionBy()
    placed = sums.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    w, cap = F.col("weight"), most * F.col("source_size")
    rising = Window.orderBy(cap / w, "place")
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(w).over(rest)
    return (
        placed.withColumn("weight", _weight(F.col("place"), weights))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(every))
        .select("src", "source_size", F.least(cap.cast("double"), F.col("level") * w).alias("target"))
    )


def _sized(df: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    source, text = F.col(source_col), F.col(text_col)
    return df.select(
        F.col(id_col).alias("id"),
        source.alias("source"),
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("src"),
        n_words(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("key"),
        F.monotonically_increasing_id().alias("place"),
        *more,
    )


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """The rows by ranges of an order, with their range's number. To be kept at once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id())


def _end(services: DataFrame, budget: float):
    """The last service in the order of ``at``, ``src``, ``key``, ``place`` that the
    budget still pays, as a row; None if it pays all, and () if it pays none."""
    before, last = 0, None
    for r in services.groupBy("range").agg(F.sum("size").alias("words")).orderBy("range").collect():  # a line a range
        if before + r["words"] > budget:
            last = r["range"]
            break
        before += r["words"]
    if last is None:
        return None
    place = F.struct("at", "src", "key", "place")
    upto = F.sum("size").over(Window.partitionBy("range").orderBy("at", "src", "key", "place").rowsBetween(Window.unboundedPreceding, 0))
    inside = services.filter(F.col("range") == last).withColumn("upto", upto + before).filter(F.col("upto") <= budget)
    for paid in (inside, services.filter(F.col("range") < last)):
        if end := paid.agg(F.max(place).alias("end")).first()["end"]:
            return end
    return ()


def _served(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """The columns of ``sized``, ``source_size``, ``target``, ``finish``, ``times``."""
    if not 0 < share <= most <= 2 or min(weights) <= 0:
        raise ValueError("weights are positive, and 0 < share <= most <= 2")
    words = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()["words"]
    # Running words by source: sums of ranges of the random order, then within each.
    ordered = scratch.keep(_ranged(sized.select("id", "source", "src", "size", "key", "place"), "src", "key", "place"))
    targets = source_targets(sized, weights, share, most)
    by_range = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("src", "range").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(by_range), F.lit(0))).drop("words").join(targets, "src")
    within = Window.partitionBy("src", "range").orderBy("key", "place").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.col("within")
    timed = scratch.keep(
        ordered.withColumn("within", F.sum("size").over(within))
        .join(offsets, ["src", "range"])
        .withColumn("finish", F.when(F.col("target") > 0, upto / F.col("target")))
        .withColumn("again", F.when(F.col("target") > 0, (upto + F.col("source_size")) / F.col("target")))
        .select("id", "source", "src", "size", "key", "place", "source_size", "target", "finish", "again")
    )
    services = timed.filter("size > 0").select("src", "size", "key", "place", F.explode(F.array("finish", "again")).alias("at")).filter("at is not null")
    end = _end(scratch.keep(_ranged(services, "at", "src", "key", "place")), share * words)
    scratch.returned(timed)

    def paid(at: str) -> Column:
        if end is None or end == ():
            return (F.col(at).isNotNull() & F.lit(end is None)).cast("int")
        place = F.struct(F.col(at).alias("at"), "src", "key", "place")
        return F.coalesce((place <= F.struct(*(F.lit(end[c]).alias(c) for c in ("at", "src", "key", "place")))).cast("int") * F.col(at).isNotNull().cast("int"), F.lit(0))

    return timed.withColumn("times", paid("finish") + paid("again")).drop("again")


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Id, ``source``, ``size``, ``source_size``, ``target``, ``finish`` (the first
    service's virtual time), ``times`` (services), ``taken`` (words served) and
    ``key`` (seeded hash of id and text) of every row; ``most`` is at most 2, as a
    document is served twice at most."""
    with Scratch(df.sparkSession) as scratch:
        timed = _served(scratch.keep(_sized(df, seed, id_col, text_col, source_col)), scratch, weights, share, most)
    return timed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "finish", "times", (F.col("size") * F.col("times")).cast("long").alias("taken"), "key")


def serve(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row as often as it is served, with the columns it came with.
    The rows are written with their places first, by which their services find them."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("payload")
    with Scratch(df.sparkSession) as scratch:
        records = scratch.keep(_sized(df, seed, id_col, text_col, source_col, whole))
        timed = _served(records, scratch, weights, share, most)
        scratch.returned(records)
    served = timed.filter("times > 0").select("place", "times")
    return records.select("place", "payload").join(served, "place").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select("payload.*")


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """What a mix with repeats takes of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
