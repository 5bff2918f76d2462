"""Models that are kept: a scaling stage for ML pipelines, and score models stored as one pipeline.

A kept model is a ``PipelineModel`` of one scaling stage and one boosted-tree model per target. A
later job loads and applies it without fitting anything.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from boutframe.learning import scaling

SCALING_SCHEMA = "feature string, kind string, lam double, side int, centre double, mean double, sigma double"


class FeatureScaler(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the scaling of ``inputCols`` (:func:`scaling.fit_scaling`) for a vector ``outputCol``.

    The data is read several times; pass a written table.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str | None = None):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FeatureScalerModel:
        fitted = scaling.fit_scaling(dataset, self.getInputCols())
        model = FeatureScalerModel(inputCols=self.getInputCols(), outputCol=self.getOutputCol())
        model.rows = fitted.collect()  # a row per feature
        return model


class FeatureScalerModel(Model, HasInputCols, HasOutputCol, MLReadable, MLWritable):
    """Adds the vector of scaled features; a missing value sits at its feature's centre."""

    rows: list[Row]

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str | None = None):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return scaling.with_feature_vector(dataset, self.rows, self.getInputCols(), self.getOutputCol())

    def parameters(self) -> DataFrame:
        """One row per feature, as :func:`scaling.fit_scaling` gives it."""
        from pyspark.sql import SparkSession

        return SparkSession.active().createDataFrame([tuple(r) for r in self.rows], SCALING_SCHEMA)

    def write(self) -> MLWriter:
        return _ScalerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ScalerReader(cls)


class _ScalerWriter(MLWriter):
    """Spark's own metadata, and the parameters as a Parquet table beside it."""

    def __init__(self, instance: FeatureScalerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.parameters().coalesce(1).write.parquet(f"{path}/parameters")


class _ScalerReader(MLReader):
    def __init__(self, cls: type[FeatureScalerModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FeatureScalerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.rows = self.sparkSession.read.schema(SCALING_SCHEMA).parquet(f"{path}/parameters").collect()
        return model


def raw_prediction(target: str) -> str:
    return f"raw_{target}"


def predicted(target: str) -> str:
    return f"predicted_{target}"


def kept_pipeline(scaler: FeatureScalerModel, models: dict[str, Model]) -> PipelineModel:
    """One pipeline of the scaling and a model per target, each with a prediction column of its own."""
    stages = [m.copy().setPredictionCol(raw_prediction(target)) for target, m in models.items()]
    return PipelineModel([scaler, *stages])


def targets_of(model: PipelineModel) -> list[str]:
    return [s.getPredictionCol().removeprefix("raw_") for s in model.stages[1:]]


def scored(model: PipelineModel, contests: DataFrame) -> DataFrame:
    """``contests`` with a prediction per target, rounded half to even at one decimal."""
    targets = targets_of(model)
    found = model.transform(contests)
    found = found.withColumns({predicted(t): F.bround(F.col(raw_prediction(t)), 1) for t in targets})
    return found.drop(model.stages[0].getOutputCol(), *map(raw_prediction, targets))
