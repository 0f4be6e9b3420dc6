"""Watching a plan run, measuring its operators, and stopping it."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import fail


def spy(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, watched as they pass: the observation's ``get`` gives, once a query
    over the result has ended, the rows that went through and how many hold a null."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    nulls = F.lit(False)
    for c in df.columns:
        nulls = nulls | F.col(f"`{c}`").isNull()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls.cast("long")), F.lit(0)).alias("rows_with_nulls"))
    return watched, seen


def profile(df: DataFrame) -> list[tuple[int, str, dict[str, int]]]:
    """Run the plan and return (depth, operator, metrics) of each node, root first: rows,
    times and sizes as Spark counts them. Times are as each metric names them."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    java = df.sparkSession._jvm.scala.jdk.javaapi.CollectionConverters
    out: list[tuple[int, str, dict[str, int]]] = []

    def visit(plan, depth: int) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return visit(plan.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return visit(plan.plan(), depth)
        found = {k: m.value() for k, m in java.asJava(plan.metrics()).items()}
        out.append((depth, plan.nodeName(), {k: int(v) for k, v in sorted(found.items()) if v >= 0}))
        for child in java.asJava(plan.children()):
            visit(child, depth + 1)

    visit(execution.executedPlan(), 0)
    return out


class Interrupt:
    """Stops what runs under it, from any thread."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.called = spark, f"skeinwork-{uuid.uuid4().hex}", False

    def interrupt(self) -> None:
        self.called = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


@contextmanager
def interruptible(interrupt: Interrupt):
    """Jobs that start in the block can be stopped by ``interrupt.interrupt()``; they
    then fail with INTERRUPTED, as does a block that is entered after the call."""
    if interrupt.called:
        fail("INTERRUPTED", "interrupted before it began")
    sc = interrupt.spark.sparkContext
    sc.addJobTag(interrupt.tag)
    try:
        yield
    except Exception as e:
        if interrupt.called:
            fail("INTERRUPTED", str(e).splitlines()[0])
        raise
    finally:
        sc.removeJobTag(interrupt.tag)
