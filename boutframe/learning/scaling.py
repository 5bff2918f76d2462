"""Feature scaling: z-scores for normal features, Yeo-Johnson for the others.

Features are unpivoted to (feature, value) and grouped by feature, so one pass with
partial aggregation serves every feature and only a row per feature is shuffled.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe.functions import distributions as dist
from boutframe.learning import power
from boutframe.operators.lookups import small_enough

NORMAL_ABOVE = 0.05


def numeric_features(df: DataFrame, exclude: list[str]) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def unpivoted(df: DataFrame, features: list[str]) -> DataFrame:
    values = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    return values.unpivot([], features, "feature", "x")


def moments(df: DataFrame, features: list[str]) -> DataFrame:
    """Counts, extremes and moments per feature, in one pass."""
    return unpivoted(df, features).groupBy("feature").agg(
        F.count("*").alias("rows_seen"),
        F.count("x").alias("n"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("sigma"),
        F.skewness("x").alias("skew"),
        F.kurtosis("x").alias("excess"),
    )


def normality(df: DataFrame, features: list[str]) -> DataFrame:
    """Moments, omnibus statistic and verdict per feature; any gap means not normal."""
    k2 = dist.normality_k2(F.col("n"), F.col("skew"), F.col("excess"))
    tested = moments(df, features).withColumn("k2", k2).withColumn("p_value", dist.normality_p(F.col("k2")))
    normal = (F.col("n") == F.col("rows_seen")) & (F.col("p_value") > NORMAL_ABOVE)
    return tested.withColumn("is_normal", F.coalesce(normal, F.lit(False)))


def yeo_johnson_lambdas(df: DataFrame, features: list[str]) -> DataFrame:
    """Maximum-likelihood lambda per feature, with its side and centre (:mod:`learning.power`).

    No lambda is out of reach. A feature without two different values keeps lambda 1.
    """
    return power.fitted_lambdas(unpivoted(df, features), features)


def fit_scaling(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature: kind, lambda, side, centre, and mean and spread of the scaled value.

    A feature whose values are all the same is ``constant``: the value is its mean, its spread
    counts as one. ``df`` is read several times; pass a written table.
    """
    spark = df.sparkSession
    schema = "feature string, kind string, lam double, side int, centre double, mean double, sigma double"
    verdicts = {r["feature"]: r for r in normality(df, features).collect()}
    constant = {f for f, r in verdicts.items() if r["low"] == r["high"]}
    plain = {f for f, r in verdicts.items() if r["is_normal"]} - constant
    skewed = [f for f in features if f not in constant | plain]
    rows = [(f, "constant", None, None, None, verdicts[f]["low"], 1.0) for f in constant]
    rows += [(f, "normal", None, None, None, verdicts[f]["mean"], verdicts[f]["sigma"]) for f in plain]
    fitted = spark.createDataFrame(rows, schema)
    if not skewed:
        return fitted
    lambdas = yeo_johnson_lambdas(df, skewed)
    moved = unpivoted(df, skewed).join(small_enough(lambdas, len(skewed), 4), "feature")
    y = dist.centred_power(F.col("x"), F.col("lam"), F.col("side"), F.col("centre"))
    powered = moved.groupBy("feature", "lam", "side", "centre").agg(
        F.avg(y).alias("mean"), F.stddev_pop(y).alias("sigma")
    )
    return fitted.unionByName(powered.select("*", F.lit("power").alias("kind")))


def standardised(value: Column, mean: float | None, sigma: float | None) -> Column:
    """Population z-score; a spread of zero counts as one."""
    if mean is None:
        return F.lit(None).cast("double")
    return (value - F.lit(mean)) / F.lit(sigma or 1.0)


def scaled_columns(params: DataFrame | list[Row], features: list[str]) -> dict[str, Column]:
    """Scaling expression per feature; the parameters hold one row per feature."""
    out = {}
    for row in params if isinstance(params, list) else params.collect():
        x = F.col(row["feature"]).cast("double")
        if row["kind"] == "power" and row["lam"] is not None:
            x = dist.centred_power(x, F.lit(row["lam"]), F.lit(row["side"]), F.lit(row["centre"]))
        out[row["feature"]] = standardised(x, row["mean"], row["sigma"])
    return {f: out[f] for f in features}


def with_feature_vector(
    df: DataFrame, params: DataFrame | list[Row], features: list[str], name: str = "features"
) -> DataFrame:
    """Add the scaled feature vector; a missing value sits at its feature's centre."""
    scaled = {f"__{f}": F.coalesce(value, F.lit(0.0)) for f, value in scaled_columns(params, features).items()}
    assembler = VectorAssembler(inputCols=list(scaled), outputCol=name)
    return assembler.transform(df.withColumns(scaled)).drop(*scaled)


def apply_scaling(df: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    """Scale ``features`` in place by fitted parameters, in one projection."""
    return df.withColumns(scaled_columns(params, features))
