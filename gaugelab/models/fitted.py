"""A fitted model: a Spark ML pipeline and how to read its scores."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = ["y_pred", "y_proba", "y_score"]


def model_folder(name: str) -> str:
    return name.lower().replace(" ", "_")


class FittedModel:
    """Scores rows with the columns y_pred, y_proba (NULL without probabilities) and y_score.

    ``output`` says what the pipeline leaves behind: ``columns`` (the three
    columns themselves) or ``vectors`` (Spark ML's prediction and probability).
    """

    def __init__(self, name: str, pipeline: PipelineModel, output: str, sources: dict[str, str] | None = None):
        self.name, self.pipeline, self.output = name, pipeline, output
        # Position in the feature vector -> raw column, for importances.
        self.sources = sources or {}

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.pipeline.transform(df)
        if self.output == "columns":
            return scored.select(*df.columns, *SCORES)
        proba = vector_to_array("probability")[1]
        return scored.select(*df.columns, F.col("prediction").cast("int").alias("y_pred"), proba.alias("y_proba"), proba.alias("y_score"))

    @property
    def classifier(self):
        return self.pipeline.stages[-1]

    def save(self, folder: str) -> str:
        """Write under ``folder`` by model name; returns the path."""
        path = f"{folder.rstrip('/')}/{model_folder(self.name)}"
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        note = json.dumps({"name": self.name, "output": self.output, "sources": self.sources})
        spark.createDataFrame([(note,)], "value string").write.mode("overwrite").text(f"{path}/note")
        return path


def load_model(folder: str, name: str) -> FittedModel:
    """Read back a model saved under its name; KNN and tree models come back as such."""
    path = f"{folder.rstrip('/')}/{model_folder(name)}"
    spark = SparkSession.active()
    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    if note["output"] == "neighbours":
        from gaugelab.models.neighbours import NeighbourModel

        return NeighbourModel.load(path, note)
    if note["output"] == "trees":
        from gaugelab.models.fitted_trees import FittedTrees

        return FittedTrees.load(path, note)
    return FittedModel(note["name"], PipelineModel.load(f"{path}/pipeline"), note["output"], note["sources"])
