"""Lineage cuts: what is computed once is written to the folder that the cluster names for checkpoints."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, read from a checkpoint: plans above stay small, and a lost executor costs no recomputation.

    The folder is spark.checkpoint.dir; only a local session without one gets a temporary folder.
    """
    with_folder(frame)
    return frame.checkpoint()


def with_folder(frame: DataFrame) -> str:
    context = frame.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="chatterlake-"))
    return context._jsc.sc().getCheckpointDir().get()


class Stored:
    """Wide or many rows of one operator as Parquet in the same folder, a few bytes a value where a checkpoint takes whole rows."""

    def __init__(self, frame: DataFrame):
        self.spark, self.folder, self.n = frame.sparkSession, f"{with_folder(frame).rstrip('/')}/stored-{uuid.uuid4().hex}", 0

    def write(self, frame: DataFrame) -> DataFrame:
        """The same rows, read from the folder; the shuffle files that they came from may go."""
        self.n += 1
        frame.write.parquet(f"{self.folder}/{self.n}")
        out = self.spark.read.schema(frame.schema).parquet(f"{self.folder}/{self.n}")
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, n: int) -> None:
        """Removes what was written as number n, counted from 1."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
