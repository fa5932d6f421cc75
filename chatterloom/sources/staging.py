"""Intermediate tables in the folder that the cluster shares for checkpoints.

A staged table cuts the lineage like a checkpoint does, but is columnar: later steps read only the
columns they need, and lost executors cost no more than re-reading some files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="chatterloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class StagingArea:
    """Staged tables of one run; `release` deletes them once results have been written.

    An operator that is called without an area stages into one of its own. Its tables stay in the
    shared folder, as checkpoint files do, since the result still reads them.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._root = f"{shared_folder(spark)}/chatterloom-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        """A place for something that is written step by step; it is deleted with the rest."""
        return f"{self._root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def stage_rdd(self, rdd: RDD, name: str) -> RDD:
        """Stage Python objects, a file per partition."""
        path = self.path(name)
        rdd.saveAsPickleFile(path, 1)
        return self._spark.sparkContext.pickleFile(path)

    def stage_by(self, df: DataFrame, name: str, column: str) -> Callable[[int], DataFrame]:
        """Stage with a folder per value of an integer column; the result reads the rows of one value."""
        path = self.path(name)
        df.write.partitionBy(column).parquet(path)
        schema = df.drop(column).schema
        folder = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self._spark._jsc.hadoopConfiguration())
        held = {status.getPath().getName() for status in files.listStatus(folder)}

        def of(value: int) -> DataFrame:
            if f"{column}={value}" not in held:
                return self._spark.createDataFrame([], schema)
            return self._spark.read.schema(schema).parquet(f"{path}/{column}={value}")

        return of

    def delete(self, path: str) -> None:
        """Delete a folder that is not read any more."""
        folder = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(folder, True)

    def release(self) -> None:
        self.delete(self._root)

    def __enter__(self) -> StagingArea:
        return self

    def __exit__(self, *_exc) -> None:
        self.release()
