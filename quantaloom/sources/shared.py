"""The folder that the driver and all executors share, and cuts of lineage that go through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names. Only a session on one machine gets a local one where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quantaloom-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder that go with the ``with`` block: what leaves the block mustn't read them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)

    def put(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again."""
        self.made += 1
        df.write.parquet(f"{self.folder}/{self.made}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.made}")

    def replace(self, df: DataFrame) -> DataFrame:
        """The same; the table that was put last, from which ``df`` comes, is removed."""
        out = self.put(df)
        remove(self.spark, f"{self.folder}/{self.made - 1}")
        return out
