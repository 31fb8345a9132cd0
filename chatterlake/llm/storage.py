"""Lineage cuts in the shared folder that the cluster names.

Iterative operators write each step as Parquet below `spark.checkpoint.dir` and read it
again: a lost executor then costs a few tasks, not the whole history.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("chatterlake.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='chatterlake-')}"
        spark.conf.set("chatterlake.shared.dir", folder)
    return folder.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for helpers: the wanted ones, with underscores until the table has none alike (Spark ignores case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in have:
            name += "_"
        have.add(name)
        out.append(name)
    return out


class Scratch:
    """Tables of one run; `drop` removes one that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.frames: list[DataFrame] = []
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """The same rows, read back from the shared folder."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.frames.append(out)  # an id belongs to one frame while it lives
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            if path := self.paths.pop(id(frame), None):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of plans that are done and referred to no more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
