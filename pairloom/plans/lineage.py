"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one of its own if all of Spark runs in this process (tests, one machine), set once; else it raises."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return str(current.get())
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="pairloom-")
        context.setCheckpointDir(named)
    return named


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    A table written here survives the loss of the executor that wrote it, is compressed, and is read with
    column pruning, which a checkpointed RDD is not. `drop` removes a table that nothing reads any more; what is left goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0
        files, root = self._files(self.root)
        files.mkdirs(root)
        files.deleteOnExit(root)

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = self.path(f"t{self.count}")
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, table: DataFrame) -> None:
        """Remove a table that `keep` gave; other DataFrames are left alone."""
        path = self.paths.pop(id(table), None)
        if path is not None:
            files, target = self._files(path)
            files.delete(target, True)
