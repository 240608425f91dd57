"""Small files and folders on whatever file system Spark reads."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken(Exception):
    """A file that was to be new is there already."""


class Files:
    """Reads and writes small text files through Hadoop's file systems, as tables are read and written."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def names(self, folder: str) -> list[str]:
        """Sorted names of what is in a folder; none if there is no such folder."""
        fs, where = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Writes a new file; raises Taken if there is one of that name."""
        fs, where = self._at(path)
        try:
            stream = fs.create(where, False)
        except Py4JJavaError as e:
            if fs.exists(where):
                raise Taken(path) from e
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share; a local session without one gets its warehouse's."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(shared)
    return shared
