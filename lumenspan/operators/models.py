"""Fitted models kept by name and version in the shared folder, and scores of rows by them.

A model is a Spark ML pipeline: features are put together, scaled and classified, so a
score is a plan over the rows and no process holds a model of its own.

Defined results: rows with a null or non-finite feature are scored with 0 in its place; a
version that is saved already is not written over; a name or version that isn't there
raises ``KeyError``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _filled(rows: DataFrame, features: list[str]) -> DataFrame:
    known = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return rows.withColumns({f"in_{f}": known(F.col(f).cast("double")) for f in features})


def fitted(rows: DataFrame, features: list[str], label: str, strength: float = 0.01, rounds: int = 50) -> PipelineModel:
    """A logistic model of ``label`` (0 or 1), fitted on all rows that have one."""
    steps = [
        VectorAssembler(inputCols=[f"in_{f}" for f in features], outputCol="assembled_"),
        StandardScaler(inputCol="assembled_", outputCol="scaled_", withMean=True, withStd=True),
        LogisticRegression(featuresCol="scaled_", labelCol="label_", regParam=strength, maxIter=rounds, probabilityCol="probability_", rawPredictionCol="raw_", predictionCol="prediction_"),
    ]
    known = _filled(rows.where(F.col(label).isNotNull()).withColumn("label_", F.col(label).cast("double")), features)
    return Pipeline(stages=steps).fit(known)


class ModelStore:
    """Models of a folder by name and version; each is read once a session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._read: dict[tuple[str, str], PipelineModel] = {}

    def _path(self, name: str, version: str) -> str:
        return f"{self.folder}/{name}/{version}"

    def _children(self, path: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def versions(self, name: str) -> list[str]:
        return self._children(f"{self.folder}/{name}")

    def save(self, name: str, version: str, model: PipelineModel) -> None:
        if version in self.versions(name):
            raise ValueError(f"{name} {version} is saved already")
        model.save(self._path(name, version))

    def load(self, name: str, version: str) -> PipelineModel:
        if (name, version) not in self._read:
            if version not in self.versions(name):
                raise KeyError(f"no model {name} {version}")
            self._read[name, version] = PipelineModel.load(self._path(name, version))
        return self._read[name, version]


def features_of(model: PipelineModel) -> list[str]:
    return [c.removeprefix("in_") for c in model.stages[0].getInputCols()]


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction`` (the likelier class) and ``probability`` (of each class, an array)."""
    found = model.transform(_filled(rows, features_of(model)))
    return found.withColumn("probability", vector_to_array("probability_")).withColumn("prediction", F.col("prediction_").cast("int")).select(*rows.columns, "prediction", "probability")
