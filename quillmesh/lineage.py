"""Written tables that cut lineage, in the folder all executors share.

Iterative operators must not grow one plan without end, and must survive the
loss of an executor. Both hold when each round is written as Parquet in the
folder named by ``spark.checkpoint.dir`` and read back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only where none is set and driver and executors are one machine."""
    named = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quillmesh-")
    return _own[app]


class SharedFiles:
    """Small files of a folder on whatever Hadoop file system holds it: local disk, HDFS or an object store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._path(name))

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._files.listStatus(self._path(""))) if self.exists() else []

    def read(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; whether this call made it."""
        try:
            stream = self._files.create(self._path(name), False)
        except Exception as error:  # noqa: BLE001 - the file system's own error types reach Python wrapped
            if self.exists(name):
                return False
            raise error
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        return True

    def drop(self, name: str) -> None:
        self._files.delete(self._path(name), True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system that holds it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Scratch tables of one operator run.

    ``write`` stores a frame and returns it as a plain scan; ``drop`` removes
    tables that no later plan reads. Tables a returned frame still reads stay
    until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillmesh/{name}-{uuid.uuid4().hex[:12]}"
        self._seq = 0

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        self._seq += 1
        path = f"{self.root}/{self._seq:03d}-{name}"
        writer = df.write.mode("overwrite").option("compression", "snappy")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        if self._seq == 1:
            self._delete_at_end()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quillmesh_path = path
        return out

    def _delete_at_end(self) -> None:
        """Have the file system remove the run's folder when the application ends."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_quillmesh_path", None)
        if path:
            drop_path(self.spark, path)
