"""Score models: training on completed contests, holdout errors, predictions."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe import fixed_values as fv
from boutframe.learning import kept, sampling, scaling
from boutframe.learning.search import FOLDS, WHOLE, search
from boutframe.session import written

TARGETS = ("away_score", "home_score")
DRAWS = 100


def evenly(low: float, high: float, points: int = 10) -> list[float]:
    return [low + (high - low) * i / (points - 1) for i in range(points)]


# FIXED VALUES: the ranges of the search, ten values per setting, as Spark ML parameters.
SEARCH_SPACE: Mapping[str, Sequence] = {
    "maxIter": [int(v) for v in evenly(200, 400)],
    "stepSize": evenly(0.001, 0.02),
    "minInfoGain": evenly(0.5, 0.7),
    "maxDepth": [round(v) for v in evenly(1, 10)],
    "minInstancesPerNode": [round(v) for v in evenly(6, 8)],
    "subsamplingRate": evenly(0.4, 0.6),
    "featureSubsetStrategy": [f"{v:.4f}" for v in evenly(0.4, 0.6)],
}


def draw_settings(space: Mapping[str, Sequence], draws: int, seed: int) -> list[dict]:
    """``draws`` random settings from the space, repeatable."""
    rng = random.Random(seed)
    return [{name: rng.choice(list(values)) for name, values in space.items()} for _ in range(draws)]


def split_features(contests: DataFrame) -> list[str]:
    """Numeric columns that are neither leading nor result columns."""
    return scaling.numeric_features(contests, [*fv.FIRST_COLUMNS, *fv.RESULT_COLUMNS])


def contest_key() -> Column:
    """A number from the contest's keys that any engine with MD5 can repeat."""
    named = F.concat_ws("|", "season", "week", "away_abbr", "home_abbr")
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def error_summary(predicted: DataFrame, target: str, prediction: str) -> DataFrame:
    """Mean absolute error, its root, and root mean squared error."""
    miss = F.col(target) - F.col(prediction)
    mae = F.avg(F.abs(miss))
    return predicted.agg(
        F.lit(target).alias("target"),
        F.count(miss).alias("n"),
        mae.alias("mae"),
        F.sqrt(mae).alias("root_mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
    )


def rounded_prediction(prediction: Column) -> Column:
    return F.bround(prediction, 1)


@dataclass(frozen=True)
class Trained:
    """A pipeline to keep, and its errors on the holdout: a row per target."""

    model: PipelineModel
    errors: DataFrame


def train(
    completed: DataFrame,
    features: list[str] | None = None,
    space: Mapping[str, Sequence] = SEARCH_SPACE,
    draws: int = DRAWS,
    folds: int = FOLDS,
    seed: int = sampling.SEED,
    scale_on_all: bool = False,
    targets: Sequence[str] = TARGETS,
    key: Column | None = None,
    **options,
) -> Trained:
    """Score models of the completed contests, one per target, with their holdout errors.

    Scaling is fitted on the training rows; ``scale_on_all`` fits it on all completed contests
    instead. All targets share the same split, by ``key`` or else by the contest's. ``options`` are
    those of the search: ``ledger``, ``rungs``, ``parallelism``.
    """
    features = features or split_features(completed)
    keyed = completed.withColumns({t: F.col(t).cast("int") for t in targets})
    table = written(keyed.withColumn("contest_key", contest_key() if key is None else key), "completed")
    held = sampling.in_holdout(F.col("contest_key"), seed=seed)
    scaler = kept.FeatureScaler(inputCols=features).fit(table if scale_on_all else table.where(~held))
    rows = written(scaler.transform(table.where(~held)).select("contest_key", "features", *targets), "train")
    settings = draw_settings(space, draws, seed)
    models = {target: search(rows, target, settings, folds, seed, **options) for target in targets}
    model = kept.kept_pipeline(scaler, models)
    test = written(model.transform(table.where(held)).select(*targets, *map(kept.raw_prediction, targets)), "holdout")
    errors = [error_summary(test, t, kept.raw_prediction(t)) for t in targets]
    for more in errors[1:]:
        errors[0] = errors[0].unionByName(more)
    return Trained(model, errors[0])


def train_and_score(completed: DataFrame, upcoming: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Predicted scores of ``upcoming`` and the holdout errors of both models; options of :func:`train`."""
    trained = train(completed, **options)
    return kept.scored(trained.model, upcoming), trained.errors
