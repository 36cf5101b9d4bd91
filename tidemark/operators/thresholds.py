"""Fit jobs for the persisted thresholds. Scoring only ever reads their result."""

from __future__ import annotations

from dataclasses import asdict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.order_stats import column_percentiles
from tidemark.operators.sample import in_sample
from tidemark.rules import TasteThresholds
from tidemark.sources.staging import read_document, write_document

LEVEL_PROBS = {"level_p50": 0.50, "level_p75": 0.75, "level_p90": 0.90}
BUILD_PROBS = {"build_t33": 0.33, "build_t67": 0.67}
COLLECTION_PROBS = {"collection_p75": 0.75}
# Column of the taste master -> names of its fitted values and their probabilities.
FITTED_COLUMNS = {"items_attack_defense_ratio": BUILD_PROBS, "coll_total_items": COLLECTION_PROBS}


def fit_columns(
    df: DataFrame, probs: dict[str, dict[str, float]]
) -> dict[str, float | None]:
    """Exact interpolated percentiles by name, for ``{column: {name: probability}}``."""
    values = df.select(*probs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = column_percentiles(values, {c: list(named.values()) for c, named in probs.items()})
    finally:
        values.unpersist()
    return {name: v for c, named in probs.items() for name, v in zip(named, found[(c, None)], strict=True)}


def fit_level(characters: DataFrame, sample: DataFrame) -> dict[str, float | None]:
    """Level percentiles over the sample's characters."""
    return fit_columns(in_sample(characters, sample), {"level": LEVEL_PROBS})


def fit_taste(master: DataFrame) -> dict[str, float | None]:
    """Terciles of the build ratio and the upper quartile of the collection size."""
    return fit_columns(master, FITTED_COLUMNS)


def fit_thresholds(master: DataFrame, characters: DataFrame, sample: DataFrame) -> TasteThresholds:
    fitted = fit_taste(master) | {"level_p75": fit_level(characters, sample)["level_p75"]}
    default = asdict(TasteThresholds())
    return TasteThresholds(**{k: default[k] if v is None else v for k, v in fitted.items()})


def save_thresholds(spark: SparkSession, thresholds: TasteThresholds, path: str) -> None:
    write_document(spark, asdict(thresholds), path)


def load_thresholds(spark: SparkSession, path: str) -> TasteThresholds:
    return TasteThresholds(**read_document(spark, path))
