"""Random search that goes on where it was stopped.

Every trial, one setting on one fold, is a row of a ledger, appended when the trial ends. A search
that starts again reads the ledger first and runs only what it lacks. With more than one rung,
settings are tried with a share of their rounds first, and only the better part goes on.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.learning import sampling
from boutframe.session import written
from boutframe.sources import store

FOLDS = 5
#: Shares of a setting's rounds, and the part of the settings that goes on to the next.
WHOLE = ((1.0, 0.0),)
HALVING = ((0.01, 0.1), (0.1, 0.1), (1.0, 0.0))

LEDGER = "study string, setting string, iterations int, fold int, mse double, seconds double"


def named(setting: dict) -> str:
    """A setting's name in the ledger."""
    return json.dumps(setting, sort_keys=True)


def study_of(rows: DataFrame, target: str, folds: int, seed: int) -> str:
    """Names the data, target and folds that trials are comparable for."""
    sums = rows.agg(F.count("*"), F.sum(F.xxhash64("contest_key", target) % 2**31), F.sum(F.col(target) * 1.0)).first()
    return hashlib.sha256(f"{target}|{folds}|{seed}|{tuple(sums)}".encode()).hexdigest()[:16]


def trials_in(ledger: DataFrame | None, study: str) -> dict[tuple[str, int, int], float]:
    """Errors recorded for a study, by setting, rounds and fold: a row per trial of the search."""
    if ledger is None:
        return {}
    known = ledger.where(F.col("study") == study).select("setting", "iterations", "fold", "mse").collect()
    return {(r["setting"], r["iterations"], r["fold"]): r["mse"] for r in known}


def search(
    train: DataFrame,
    target: str,
    settings: list[dict],
    folds: int = FOLDS,
    seed: int = sampling.SEED,
    parallelism: int = 2,
    ledger: str | None = None,
    rungs: Sequence[tuple[float, float]] = WHOLE,
) -> Model:
    """The model of the setting with the least cross-validated squared error, fitted on all rows.

    ``train`` has ``features``, ``contest_key`` and the target. Each rung tries the settings that are
    left with a share of their own ``maxIter`` and passes on the given part of them, at least one.
    ``ledger`` is the path of the trials' table, of this and of other searches; without one they are
    not kept. Of equal errors, the setting drawn first wins.
    """
    spark = train.sparkSession
    folded = sampling.stratified_folds(train, target, "contest_key", folds, seed=seed)
    slim = written(folded.select("features", "contest_key", F.col(target).cast("double"), "fold"), f"fold-{target}")
    study = study_of(slim, target, folds, seed)
    known = trials_in(store.read_if_present(spark, ledger) if ledger else None, study)
    judge = RegressionEvaluator(labelCol=target, metricName="mse")

    def trial(setting: dict, iterations: int, fold: int) -> float:
        key = (named(setting), iterations, fold)
        if key not in known:
            began = time.monotonic()
            model = learner(target, setting, iterations, seed).fit(slim.where(F.col("fold") != fold))
            known[key] = judge.evaluate(model.transform(slim.where(F.col("fold") == fold)))
            if ledger:
                row = [(study, *key, known[key], time.monotonic() - began)]
                # A folder per trial, as jobs that append to one folder clear each other's files.
                spark.createDataFrame(row, LEDGER).coalesce(1).write.parquet(f"{ledger}/trial={uuid.uuid4().hex}")
        return known[key]

    left = list({named(s): s for s in settings}.values())
    for share, part in rungs:
        tries = [(s, max(1, round(s["maxIter"] * share)), fold) for s in left for fold in range(folds)]
        with ThreadPoolExecutor(parallelism) as pool:
            try:
                errors = list(pool.map(lambda t: trial(*t), tries))
            except BaseException:
                pool.shutdown(cancel_futures=True)
                raise
        means = [sum(errors[i * folds : (i + 1) * folds]) / folds for i in range(len(left))]
        order = sorted(range(len(left)), key=lambda i: (means[i], i))
        left = [left[i] for i in order[: max(1, math.ceil(len(left) * part))]]
    return learner(target, left[0], left[0]["maxIter"], seed).fit(slim)


def learner(target: str, setting: dict, iterations: int, seed: int) -> GBTRegressor:
    """A boosted-tree regressor with a setting, for so many rounds."""
    return GBTRegressor(
        featuresCol="features", labelCol=target, lossType="squared", seed=seed, **{**setting, "maxIter": iterations}
    )
