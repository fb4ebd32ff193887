"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir); where that is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="nearfold-"))
    return sc.getCheckpointDir()


def once(df: DataFrame) -> DataFrame:
    """`df` computed and written to the shared folder: what uses it several times, or in many rounds, reads it there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder, through Hadoop."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Ring:
    """Folders for a state that is replaced again and again: each put() writes a table to the shared folder, and what was
    written `room` puts before is deleted.  A written table cuts the lineage and survives lost executors, as a checkpoint
    does, but a loop of any length leaves no more than `room` of them behind, and close() none."""

    def __init__(self, spark: SparkSession, room: int = 1):
        self.spark, self.room = spark, room
        self.folder, self.made = f"{shared_folder(spark)}/ring-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{self.made}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.made}")
        if self.made >= self.room:
            self._delete(f"{self.folder}/{self.made - self.room}")
        self.made += 1
        return out

    def close(self) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        delete(self.spark, path)
