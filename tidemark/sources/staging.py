"""Written intermediate tables, sinks and the broadcast bound."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# A side of a join is broadcast only if it was counted and has at most this many rows.
SMALL_ROWS = 100_000


@cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"tidemark-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names for intermediate tables.

    Where it is unset, a session that runs in one machine gets a folder of its own. On a cluster
    executors would not see each other's files there, so the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def stage(df: DataFrame, label: str, written: list[str] | None = None) -> DataFrame:
    """Write a table once and read it back.

    This cuts the lineage on storage every executor reaches, so a lost executor costs one re-read,
    and later queries scan only the columns they use. The path is added to ``written``; whatever its
    owner does not discard goes when the application ends.
    """
    path = staging_path(df.sparkSession, label)
    target = _hadoop_path(df.sparkSession, path)
    target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.mode("overwrite").parquet(path)
    if written is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, written: list[str]) -> None:
    """Remove staged tables once their readers are done."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while written:
        path = _hadoop_path(spark, written.pop())
        path.getFileSystem(conf).delete(path, True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    """Final sink. ``by`` lays the output out in one folder per value."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        # The literal 'null' is a legal axis value, so a real null is written as an empty field.
        writer = writer.option("header", True).option("nullValue", "")
    if by is not None:
        writer = writer.partitionBy(by)
    writer.save(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A summary document of bounded size, as one JSON line."""
    text = json.dumps(document, ensure_ascii=False, default=str)
    (
        spark.createDataFrame([(text,)], "value string").coalesce(1)
        .write.mode("overwrite").text(path)
    )


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
