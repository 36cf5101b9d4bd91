"""Readers for table exports (CSV or Parquet) and for stored out-of-fold scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.rules import TARGETS
from tidemark.sources.canonical import Tables
from tidemark.sources.catalog import FILE_NAMES, LOG_TABLES, SCHEMAS
from tidemark.sources.identify import identify, table_headers


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One export. CSV columns arrive as strings (no inference pass over the data)."""
    clean = path.rstrip("/")
    if clean.endswith((".csv", ".csv.gz")):
        return (
            spark.read.option("header", True).option("mode", "PERMISSIVE")
            .option("escape", '"').option("multiLine", False).csv(path)
        )
    if clean.endswith(".json"):
        return spark.read.option("primitivesAsString", True).json(path)
    if clean.endswith(".orc"):
        return spark.read.orc(path)
    return spark.read.parquet(path)


def pick_tables(spark: SparkSession, files: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """{table: file contents}: snapshot tables by their headers, logs by their names.

    A thin export can miss so many optional columns that its header identifies nothing; it is
    still taken if it has the usual name and every required column.
    """
    found = identify(table_headers(spark, files)).where(F.col("schema").isNotNull())
    tables = {r["schema"]: files[r["file"]] for r in found.collect()}  # one per schema at most
    named = {file.split(".")[0]: df for file, df in files.items()}
    for table, usual in FILE_NAMES.items():
        df = named.get(usual.removesuffix(".csv"))
        if table in tables or df is None:
            continue
        if table in LOG_TABLES or set(SCHEMAS[table].required) <= set(df.columns):
            tables[table] = df
    return tables


def read_directory(spark: SparkSession, directory: str) -> Tables:
    files = list_files(spark, directory)
    return Tables(spark, pick_tables(spark, {n: read_table(spark, p) for n, p in files.items()}))


def list_files(spark: SparkSession, directory: str) -> dict[str, str]:
    """{file name: path} of a directory on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = ("csv", "gz", "parquet", "orc", "json")
    out = {}
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.rsplit(".", 1)[-1] in names and not name.startswith(("_", ".")):
            out[name] = status.getPath().toString()
    return dict(sorted(out.items()))


# --- fixed values: names the stored scores have been saved under -----------------------------------
OOF_NAMES = {
    "churn_7d": ("p_churn_7d", "prob_churn_7d_oof", "churn_prob_7d_oof"),
    "churn_14d": ("p_churn_14d", "prob_churn_14d_oof", "churn_prob_14d_oof"),
    "churn_30d": ("p_churn_30d", "prob_churn_30d_oof", "churn_prob_30d_oof"),
}


def oof_scores(spark: SparkSession, stored: DataFrame | None) -> DataFrame:
    """user_id + churn_prob_<h>_oof from either naming scheme; no table gives no rows."""
    names = {t: f"churn_prob_{t.split('_', 1)[1]}_oof" for t in TARGETS}
    if stored is None:
        return spark.createDataFrame(
            [], "user_id string, " + ", ".join(f"{n} double" for n in names.values())
        )
    cols = [F.col("user_id").cast("string").alias("user_id")]
    for target, name in names.items():
        known = [c for c in OOF_NAMES[target] if c in stored.columns]
        score = F.col(known[0]).cast("double") if known else F.lit(None).cast("double")
        cols.append(F.when(~F.isnan(score), score).alias(name))
    return stored.select(*cols)
