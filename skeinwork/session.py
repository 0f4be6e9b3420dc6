"""Session helpers: where durable intermediate results go, and how they leave."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that a session should have. A generated method of more than 8000 bytes is
#: never compiled by the JVM and runs interpreted: beyond that, wide projections are
#: faster without whole-stage code.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.adaptive.enabled": "true"}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a single machine may leave
    that setting out and gets a temporary folder; anywhere else executors would each
    write to a disk of their own, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skeinwork-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` now, keep it on shared storage and cut its lineage.

    Lost executors lose nothing of the result: readers go to the shared folder. Spark
    removes the files once the driver no longer refers to the result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing_shuffles(spark: SparkSession):
    """Within it, each job's shuffle files go when the job has ended."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


#: Bytes of an Arrow batch that Python steps read. Spark's own bound is 64 MB: then each
#: running task holds such a batch several times, in the JVM's buffers and in its worker.
BATCH_BYTES = 2 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on Python steps of the session read batches of about BATCH_BYTES, unless
    it has a bound of its own. Tasks look the bound up as they run, so it stays for
    results that are yet to be computed. A single longer row is a batch of its own."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


_scopes: list[list[str]] = []


@contextmanager
def scratch_ends(spark: SparkSession):
    """When the block ends, all scratch tables made within it go, those that results
    still read included: for callers that have written these results."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            delete(spark, folder)


class Scratch:
    """The tables of an operator's steps: Parquet in the shared folder.

    Lost executors lose none of them, readers take only the columns they need, and
    plans know their sizes. Tables are dropped by hand as soon as no later step reads
    them; when the block ends all go but those that ``returned`` was told of, which
    the caller's result still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.needed: set[int] = set()
        for scope in _scopes:
            scope.append(self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        with freeing_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.paths.pop(id(t))[1])

    def returned(self, *tables: DataFrame) -> None:
        self.needed.update(map(id, tables))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, failed, *_) -> None:
        for key, (_, path) in list(self.paths.items()):
            if failed or key not in self.needed:
                delete(self.spark, path)
                del self.paths[key]
        if not self.paths:
            delete(self.spark, self.folder)
