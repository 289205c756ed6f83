"""Cutting lineage through a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session may leave it unset; it then gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="commweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Snapshot:
    """A DataFrame written as Parquet to the shared folder and read back, so that lost executors cost no recomputation.

    by: a column whose values lie in folders of their own. drop() removes the files once no later plan reads them; the
    others are removed when the application ends.
    """

    def __init__(self, df: DataFrame, by: str | None = None):
        self.path = f"{shared_dir(df.sparkSession)}/snapshot-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(self.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self.path)
        files, path = self._files()
        files.deleteOnExit(path)

    def _files(self):
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path

    def drop(self) -> None:
        files, path = self._files()
        files.delete(path, True)
        files.cancelDeleteOnExit(path)
