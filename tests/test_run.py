from pyspark.sql import functions as F

from boutframe.operators.features import COMPARED
from boutframe.plans import run
from boutframe.plans.catalogue import SMALL_SPACE
from boutframe.plans.domain import AS_OF, SPAN, Domain
from boutframe.session import written_so_far
from boutframe.sources import store

ROOT = "/root/testdata/sf0.001"


def test_build_and_predict(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    d = Domain(spark, ROOT)
    for name, table in {
        "games": d.games(), "boxscores": d.boxscores(), "ratings": d.ratings(),
        "rankings_raw": d.rankings_raw(), "divisions": d.divisions(), "codes": d.code_lookup(),
    }.items():
        table.write.parquet(f"{source}/{name}")
    d.closing_quotes().coalesce(1).write.option("header", True).csv(f"{source}/lines.csv")

    mark = written_so_far()
    table = run.build(spark, source, out, SPAN)
    assert written_so_far() == mark
    done = store.read_if_present(spark, f"{out}/completed_games/v000001")
    coming = store.read_if_present(spark, f"{out}/predict/season_2001_week_11_games_to_predict/v000001")
    assert done.count() == table.where("result IS NOT NULL").count() > 0
    assert coming.count() == table.where("season = 2001 AND week = 11").count() > 0
    assert "surface_factor" not in table.columns

    # A second run refreshes the partitions around the current week only.
    facts = f"{out}/team_games"
    before = {f for f in spark.read.parquet(facts).inputFiles()}
    run.build(spark, source, out, SPAN, keep_versions=1)
    assert store.read_if_present(spark, f"{out}/all_data/v000001") is None
    changed = before ^ set(spark.read.parquet(facts).inputFiles())
    assert changed and all("season=2001/week=1" in f for f in changed)
    assert {f.split("week=")[1].split("/")[0] for f in changed} == {"10", "11", "12"}

    features = [f"{s}_diff" for s in COMPARED[:4]]
    coming = store.read_if_present(spark, f"{out}/predict/season_2001_week_11_games_to_predict/v000002")
    scored = run.predict(spark, out, AS_OF, features=features, space=SMALL_SPACE, draws=1, folds=2)
    assert scored.count() == coming.count()
    assert scored.where(F.col("predicted_home_score").isNull()).count() == 0
    assert spark.read.parquet(f"{out}/holdout_errors/v000001").count() == 2

    # A second job scores with the model kept, and fits nothing.
    ledger = spark.read.parquet(f"{out}/search_ledger")
    trials = ledger.count()
    assert trials == 2 * 2
    again = run.score(spark, out, AS_OF)
    assert store.newest_version(spark, f"{out}/model").endswith("v000001")
    assert again.exceptAll(scored).count() == 0 == scored.exceptAll(again).count()
    assert spark.read.parquet(f"{out}/search_ledger").count() == trials
    # Training again finds all trials in the ledger and keeps a second model.
    run.train(spark, out, features=features, space=SMALL_SPACE, draws=1, folds=2)
    assert spark.read.parquet(f"{out}/search_ledger").count() == trials
    assert store.newest_version(spark, f"{out}/model").endswith("v000002")
