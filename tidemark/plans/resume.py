"""Tables of a run that outlive it, so that a failed run goes on after its last finished stage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of all files below a path; their contents are not read."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    files = fs.listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def run_key(*parts: object) -> str:
    """One name for everything a run depends on."""
    return hashlib.sha256("\n".join(map(repr, parts)).encode()).hexdigest()[:32]


@dataclass
class StagedRun:
    """Finished tables of one run below ``<folder>/<key>``; a table is finished once it has its mark.

    The key stands for the inputs, models and rules, so a table is never taken for another run.
    """

    spark: SparkSession
    folder: str
    key: str

    @property
    def root(self) -> str:
        return f"{self.folder.rstrip('/')}/{self.key}"

    def finished(self, label: str) -> bool:
        fs, mark = _hadoop(self.spark, f"{self.root}/{label}/_SUCCESS")
        return fs.exists(mark)

    def table(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{label}"
        if not self.finished(label):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        """Remove the tables of this run; nothing reads them any more."""
        fs, at = _hadoop(self.spark, self.root)
        fs.delete(at, True)
