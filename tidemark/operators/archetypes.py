"""Archetypes by given centroids: the whole model is one small document.

The document holds what turns a row of the master into a vector, and the centroids::

    {"version": "a1",
     "numbers": [{"column": "char_count", "fill": 1.2, "mean": 1.5, "scale": 0.8}, ...],
     "categories": [{"column": "country", "values": ["ES", "US"], "means": [0.1, 0.2, 0.7], "scales": [0.3, 0.4, 0.5]}, ...],
     "centroids": [{"code": 0, "vector": [...]}, ...]}

A missing number takes ``fill``; a category has one place per value and a last one for all others (a
missing value is the text that ``category_key`` gives it). Every place is (x - mean) / scale, and 0 where the
scale is 0. Nothing is fitted when rows are assigned, so SQL can repeat it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from importlib import resources

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import StandardScalerModel, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.clusters import nearest_centroid
from tidemark.operators.encode import category_key
from tidemark.operators.models import ArchetypeModel, align
from tidemark.sources.staging import read_document, write_document


@dataclass(frozen=True)
class CentroidArchetypes:
    """A model document; see the module."""

    document: dict

    def __post_init__(self) -> None:
        width = len(self.document["numbers"]) + sum(len(c["values"]) + 1 for c in self.document["categories"])
        for c in self.document["categories"]:
            if not len(c["values"]) + 1 == len(c["means"]) == len(c["scales"]):
                raise ValueError(f"{c['column']}: means and scales need one place per value and one more")
        wrong = [c["code"] for c in self.document["centroids"] if len(c["vector"]) != width]
        if wrong or not self.document["centroids"]:
            raise ValueError(f"centroids must have {width} places; these have not: {wrong}")

    @property
    def features(self) -> list[str]:
        return [f["column"] for kind in ("numbers", "categories") for f in self.document[kind]]

    def vector(self, master: DataFrame) -> Column:
        def scaled(x: Column, mean: float, scale: float) -> Column:
            return (x - F.lit(float(mean))) / F.lit(float(scale)) if scale else F.lit(0.0)

        places = [
            scaled(F.coalesce(F.col(n["column"]).cast("double"), F.lit(float(n["fill"]))), n["mean"], n["scale"])
            for n in self.document["numbers"]
        ]
        for c in self.document["categories"]:
            key = category_key(master, c["column"])
            tests = [key == F.lit(v) for v in c["values"]] + [~key.isin(*c["values"]) if c["values"] else F.lit(True)]
            places += [scaled(t.cast("double"), m, s) for t, m, s in zip(tests, c["means"], c["scales"], strict=True)]
        return F.array(*places)

    def assign(self, master: DataFrame) -> DataFrame:
        """user_id, archetype_n1, distance (squared); the lowest code on a tie."""
        rows = align(master, self.features, self.document["version"])
        centroids = rows.sparkSession.createDataFrame(
            [(c["code"], [float(x) for x in c["vector"]]) for c in self.document["centroids"]], "code int, centroid array<double>"
        )
        return nearest_centroid(rows.select("user_id", self.vector(rows).alias("vector")), "vector", centroids).drop("vector")

    def save(self, spark: SparkSession, folder: str) -> None:
        write_document(spark, self.document, f"{folder}/{self.document['version']}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: str) -> CentroidArchetypes:
        return cls(read_document(spark, f"{folder}/{version}/centroids"))

    @classmethod
    def packaged(cls, name: str) -> CentroidArchetypes:
        """A document that comes with the library."""
        return cls(json.loads(resources.files("tidemark.plans").joinpath(name).read_text("utf-8")))

    @classmethod
    def of(cls, model: ArchetypeModel) -> CentroidArchetypes:
        """The document of a fitted model."""
        stages = model.pipeline.stages
        scaler = next(s for s in stages if isinstance(s, StandardScalerModel))
        kmeans = next(s for s in stages if isinstance(s, KMeansModel))
        indexer = next((s for s in stages if isinstance(s, StringIndexerModel)), None)
        means, scales = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
        numbers = [
            {"column": c, "fill": fill, "mean": means[i], "scale": scales[i]} for i, (c, fill) in enumerate(model.fills.items())
        ]
        categories, at = [], len(numbers)
        for c, values in zip(model.texts, indexer.labelsArray if indexer is not None else (), strict=True):
            end = at + len(values) + 1
            categories.append({"column": c, "values": list(values), "means": means[at:end], "scales": scales[at:end]})
            at = end
        centroids = [{"code": i, "vector": c.tolist()} for i, c in enumerate(kmeans.clusterCenters())]
        return cls({"version": model.version, "numbers": numbers, "categories": categories, "centroids": centroids})
