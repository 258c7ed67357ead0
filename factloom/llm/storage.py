"""The shared folder, and tables written to it to cut lineage.

The folder is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests, a single machine)
a folder of this application is made.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URL of the folder that the driver and every executor can see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors would write to folders that nobody else sees")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="factloom-shared-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; a lost executor then costs nothing upstream."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> str | list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        out.append(own)
    return out[0] if len(out) == 1 else out


class Scratch:
    """Tables of one operator that its result does not read: :meth:`clear` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`materialize`."""
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            drop_path(self.spark, self.paths.pop())


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int, most: int = 8_000_000):
    """Arrow batches of ``rows`` and ``most`` bytes at most for the jobs run inside: a batch of texts and what is made of it are what a worker holds."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": most}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        own = int(str(before[k]).rstrip("bB"))
        spark.conf.set(k, str(min(own, v) if own > 0 else v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """The shuffle files of what is written inside go when it is written, not whenever the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what a finished step wrote, through Hadoop's file system so that any shared store works."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
