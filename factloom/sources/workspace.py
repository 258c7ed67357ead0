"""The folder that the driver and all executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a folder of this application's only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors would write to folders that nobody else sees")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="factloom-work-")
    return _own[app]


def local(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A small table of declarations. Unlike a frame over Python rows its size is known, so the optimizer broadcasts it and drops what meets an empty one."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes and rereads: later steps start from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Files:
    """Small files of a folder through Hadoop's file system, so that any store that Spark writes will do."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not exist: the compare-and-swap of all commits. False if somebody else was first."""
        p = self._path(self.path(name))
        self._fs.mkdirs(p.getParent())
        try:
            out = self._fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str | None:
        p = self._path(self.path(name))
        if not self._fs.exists(p):
            return None
        data = self._fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()

    def names(self, folder: str = "") -> list[str]:
        p = self._path(self.path(folder) if folder else self.base)
        if not self._fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)
