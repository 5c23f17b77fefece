"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder already set.

    Only where neither is set and the master is local (tests) is a temporary folder made and set; a
    cluster without a shared folder is an error, as each host's own folder would lose data.
    """
    here = spark.conf.get("spark.checkpoint.dir", None)
    if here:
        return here.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Paths that shared_path gave, by application.
_given: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there is intermediate (discard)."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Delete what this application wrote to paths of shared_path, once its results are stored elsewhere; tells how many paths."""
    paths = _given.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        SharedFiles(spark, path).delete("")
    return len(paths)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class SharedFiles:
    """Small files in one folder of any file system that Spark knows, for the driver's own notes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def make(self) -> None:
        self.fs.mkdirs(self.folder)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.folder)] if self.fs.exists(self.folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a new file whole: it appears by a rename."""
        self.make()
        part = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(part, self._path(name)):
            raise FileExistsError(f"{name} is there already: two queries write this table")

    def delete(self, name: str) -> None:
        """Delete a file or folder; no name is the folder itself."""
        self.fs.delete(self._path(name) if name else self.folder, True)
