"""Cutting lineage with tables written to the folder that the cluster shares.

``stage`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads
it back, so that a lost executor costs no recomputation of earlier rounds and
plans of iterative operators stay small.  Where the setting is absent (tests on
one machine) a temporary folder of this process is set once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a private one in local mode where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="talus-stage-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return _local[0]


class Staged:
    """The tables one operator call has written; ``drop`` removes those no longer read.

    What a lazy result still reads stays until the application ends; then the
    whole folder of the call is deleted.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        path, fs = self._at(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path = getattr(table, "_staged_path", None)
            if path:
                at, fs = self._at(path)
                fs.delete(at, True)
