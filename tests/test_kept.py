"""Models that are kept, and the search that goes on where it was stopped."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from boutframe.learning import kept, model, scaling, search
from boutframe.sources import store

SCHEMA = "id long, skewed double, plain double, gappy double, same double, y int"


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = random.Random(7)
    made = []
    for i in range(600):
        skewed, plain = rng.expovariate(1), rng.gauss(0, 1)
        made.append((i, skewed, plain, None if i % 4 == 0 else rng.random(), 3.0, round(10 * skewed + 4 * plain)))
    path = f"file://{tmp_path_factory.mktemp('kept')}/rows"
    spark.createDataFrame(made, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


FEATURES = ["skewed", "plain", "gappy", "same"]
SPACE = {"maxIter": [6, 8], "stepSize": [0.3], "maxDepth": [3, 4]}


def trained(rows, **options):
    return model.train(rows, FEATURES, SPACE, targets=["y"], key=F.col("id"), folds=2, **options)


def test_a_reloaded_model_scores_the_same(spark, rows, tmp_path):
    found = trained(rows, draws=2)
    found.model.save(f"file://{tmp_path}/model")
    again = PipelineModel.load(f"file://{tmp_path}/model")
    assert kept.targets_of(again) == ["y"]
    before, after = (kept.scored(m, rows) for m in (found.model, again))
    assert before.columns == [*rows.columns, "predicted_y"]
    assert before.exceptAll(after).count() == 0 == after.exceptAll(before).count()
    error = found.errors.first()
    deviation = rows.agg(F.stddev_pop("y")).first()[0]
    assert error["target"] == "y" and error["rmse"] < 0.6 * deviation


def test_the_scaling_stage_is_kept_exactly(spark, rows, tmp_path):
    stage = kept.FeatureScaler(inputCols=FEATURES, outputCol="v")
    stage.save(f"file://{tmp_path}/stage")
    stage = kept.FeatureScaler.load(f"file://{tmp_path}/stage")
    fitted = stage.fit(rows)
    fitted.save(f"file://{tmp_path}/fitted")
    again = kept.FeatureScalerModel.load(f"file://{tmp_path}/fitted")
    assert again.rows == fitted.rows and again.getOutputCol() == "v" and again.uid == fitted.uid
    assert {r["feature"]: r["kind"] for r in again.parameters().collect()}["same"] == "constant"
    plain = scaling.apply_scaling(rows, again.parameters(), FEATURES).fillna(0.0, FEATURES).orderBy("id").collect()
    vectors = again.transform(rows).orderBy("id").collect()
    assert [list(r["v"]) for r in vectors] == [[r[f] for f in FEATURES] for r in plain]


def small(spark):
    rng = random.Random(5)
    made = [(i, i, rng.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame([(k, x, round(3 * x), float(x > 0)) for k, _, x in made], "contest_key long, x double, y int, sign double")
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["x", "sign"], outputCol="features").transform(df)


def test_a_hundred_draws_killed_and_resumed(spark, tmp_path, monkeypatch):
    """The real space, on a bounded sample: rungs of a hundredth and a hundredth and a half of the rounds."""
    ledger, rungs = f"file://{tmp_path}/ledger", ((0.005, 0.05), (0.015, 0.0))
    settings = model.draw_settings(model.SEARCH_SPACE, 100, seed=42)
    tried, fit, alive = [], search.learner, [60]

    def counted(target, setting, iterations, seed):
        alive[0] -= 1
        if alive[0] < 0:
            raise RuntimeError("killed")
        tried.append((search.named(setting), iterations))
        return fit(target, setting, min(iterations, 6), seed)

    monkeypatch.setattr(search, "learner", counted)
    train = small(spark)
    with pytest.raises(RuntimeError, match="killed"):
        search.search(train, "y", settings, folds=2, parallelism=4, ledger=ledger, rungs=rungs)
    recorded = spark.read.parquet(ledger).count()
    assert 50 <= recorded < 100
    tried.clear()
    alive[0] = 10_000
    best = search.search(train, "y", settings, folds=2, parallelism=4, ledger=ledger, rungs=rungs)
    distinct = len({search.named(s) for s in settings})
    first, second = 2 * distinct, 2 * -(-distinct * 5 // 100)
    # All trials but the recorded ones, and the fit of the best setting on all rows.
    assert len(tried) == first + second - recorded + 1
    rows = spark.read.parquet(ledger)
    assert rows.count() == first + second == rows.select("setting", "iterations", "fold").distinct().count()
    # The rung's best go on, and the best of those is fitted with all its rounds.
    means = rows.groupBy("setting", "iterations").agg(F.avg("mse").alias("mse")).collect()
    low = {r["setting"]: r["mse"] for r in means if r["iterations"] <= 2}
    high = {r["setting"]: r["mse"] for r in means if r["iterations"] > 2}
    assert set(high) <= set(low) and len(high) == second // 2
    assert tried[-1][0] == min(high, key=high.get) and tried[-1][1] >= 200
    # A third run has nothing left to try but that fit.
    tried.clear()
    again = search.search(train, "y", settings, folds=2, ledger=ledger, rungs=rungs)
    trees = [m.toDebugString.split("\n", 1)[1] for m in (best, again)]  # but for the model's own name
    assert len(tried) == 1 and trees[0] == trees[1]


def test_other_data_is_another_study(spark, tmp_path):
    train = small(spark)
    one = search.study_of(train, "y", 2, 42)
    assert one == search.study_of(train.repartition(7), "y", 2, 42)
    assert one != search.study_of(train.where("contest_key <> 3"), "y", 2, 42)
    assert one != search.study_of(train, "y", 3, 42)


def test_scoring_without_a_model_says_so(spark, tmp_path):
    from datetime import date

    from boutframe.plans import run

    season, week = run.current_step(spark, date(2001, 11, 20))
    name = run.upcoming_name(season, week)
    assert str(season) in name
    store.materialize(spark, f"file://{tmp_path}/{name}", lambda: spark.range(1))
    with pytest.raises(FileNotFoundError, match="no model"):
        run.score(spark, f"file://{tmp_path}", date(2001, 11, 20))
