"""Which export is which: header similarity, conflicts, missing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.catalog import MIN_MATCH_SCORE, SCHEMAS, WARN_BELOW


def table_headers(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(file, column) of the given tables; schemas only, no data is read."""
    rows = [(name, c) for name, df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "file string, column string")


def declared_columns(spark: SparkSession) -> DataFrame:
    rows = [
        (i, name, col, required)
        for i, (name, s) in enumerate(SCHEMAS.items())
        for cols, required in ((s.required, True), (s.optional, False))
        for col in cols
    ]
    return spark.createDataFrame(
        rows, "place int, schema string, column string, required boolean"
    )


def match_scores(headers: DataFrame) -> DataFrame:
    """One row per (file, schema) that share a column: similarity and missing required columns."""
    spark = headers.sparkSession
    declared = declared_columns(spark)
    headers = headers.distinct()
    sizes = declared.groupBy("place", "schema").agg(
        F.count(F.lit(1)).alias("n_declared"), F.count_if("required").alias("n_required")
    )
    widths = headers.groupBy("file").agg(F.count(F.lit(1)).alias("n_found"))
    shared = headers.join(declared, "column").groupBy("file", "schema").agg(
        F.count(F.lit(1)).alias("n_shared"), F.count_if("required").alias("n_required_found")
    )
    union = F.col("n_found") + F.col("n_declared") - F.col("n_shared")
    complete = (F.col("n_required") > 0) & (F.col("n_required_found") == F.col("n_required"))
    jaccard = F.col("n_shared") / union
    return shared.join(sizes, "schema").join(widths, "file").select(
        "file", "place", "schema",
        F.when(complete, F.least(F.lit(1.0), jaccard + 0.1)).otherwise(jaccard).alias("score"),
        (F.col("n_required") - F.col("n_required_found")).cast("int").alias("n_missing_required"),
    )


def identify(headers: DataFrame) -> DataFrame:
    """One row per file: its schema (null if unrecognised), score and a weak-match flag.

    The best score wins, the first declared schema on a tie. If two files claim one schema, the
    higher score keeps it, the first file name on a tie; the other file is unrecognised.
    """
    best = Window.partitionBy("file").orderBy(F.desc("score"), F.asc("place"))
    claims = (
        match_scores(headers)
        .withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    )
    files = headers.select("file").distinct().join(claims, "file", "left")
    claimed = F.when(F.col("score") >= MIN_MATCH_SCORE, F.col("schema"))
    rival = Window.partitionBy(claimed).orderBy(F.desc("score"), F.asc("file"))
    kept = claimed.isNotNull() & (F.row_number().over(rival) == 1)
    return files.select(
        "file",
        F.when(kept, F.col("schema")).alias("schema"),
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
        (kept & (F.col("score") < WARN_BELOW)).alias("weak_match"),
        F.when(kept, F.col("n_missing_required")).alias("n_missing_required"),
    )


def missing_required(headers: DataFrame, identified: DataFrame) -> DataFrame:
    """(schema, file, column) for each required column a recognised file lacks."""
    spark = headers.sparkSession
    need = declared_columns(spark).where("required").select("schema", "column")
    known = identified.where(F.col("schema").isNotNull()).select("file", "schema")
    return known.join(need, "schema").join(headers, ["file", "column"], "left_anti")


def validation_report(headers: DataFrame) -> DataFrame:
    """(schema, file, score, severity, message); the input is valid if no row is an error.

    An empty header table (no directory, or no files in it) is one error row.
    """
    spark = headers.sparkSession
    if headers.isEmpty():
        return spark.createDataFrame(
            [(None, None, None, "error", "no input tables")],
            "schema string, file string, score double, severity string, message string",
        )
    ident = identify(headers)
    policy = spark.createDataFrame(
        [(name, s.on_missing) for name, s in SCHEMAS.items()], "schema string, on_missing string"
    )
    found = ident.where(F.col("schema").isNotNull())
    gaps = missing_required(headers, ident).groupBy("schema", "file").agg(
        F.array_join(F.sort_array(F.collect_set("column")), ", ").alias("cols")
    )
    absent = policy.join(found, "schema", "left_anti").select(
        "schema", F.lit(None).cast("string").alias("file"), F.lit(None).cast("double").alias("score"),
        F.when(F.col("on_missing") == "fail", "error").otherwise("warning").alias("severity"),
        F.concat(F.lit("table not found: "), F.col("schema")).alias("message"),
    )
    lacking = found.join(gaps, ["schema", "file"]).select(
        "schema", "file", "score", F.lit("error").alias("severity"),
        F.concat(F.lit("missing required columns: "), F.col("cols")).alias("message"),
    )
    fine = found.join(gaps, ["schema", "file"], "left_anti").select(
        "schema", "file", "score",
        F.when(F.col("weak_match"), "warning").otherwise("ok").alias("severity"),
        F.when(F.col("weak_match"), "weak match").otherwise("recognised").alias("message"),
    )
    unknown = ident.where(F.col("schema").isNull()).select(
        F.lit(None).cast("string").alias("schema"), "file", "score",
        F.lit("info").alias("severity"), F.lit("not recognised").alias("message"),
    )
    return fine.unionByName(lacking).unionByName(unknown).unionByName(absent)


def is_valid(report: DataFrame) -> bool:
    return report.where(F.col("severity") == "error").isEmpty()
