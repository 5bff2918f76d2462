import pytest
from pyspark.sql import functions as F

from boutframe.sources import colocated as co
from boutframe.sources import store

KEYS = ["season", "week", "abbr"]


def rows(spark, n=3000):
    # One entity has a third of all rows.
    entity = F.when(F.col("id") % 3 == 0, F.lit("A")).otherwise(F.concat(F.lit("E"), (F.col("id") % 40).cast("string")))
    return spark.range(n).select(
        (2000 + F.col("id") % 7).cast("int").alias("season"), (F.col("id") % 17 + 1).cast("int").alias("week"),
        entity.alias("abbr"), F.col("id").alias("value"),
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_sides_do_not_move(spark, tmp_path):
    facts = rows(spark)
    form = facts.groupBy(*KEYS).agg(F.sum("value").alias("form"))
    stored = co.store_colocated(facts, f"{tmp_path}/facts", KEYS, 16)
    stored_form = co.store_colocated(form, f"{tmp_path}/form", KEYS, 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = stored.join(stored_form, KEYS)
        assert "Exchange" not in plan_of(both)
        games = facts.select("season", "week", F.col("abbr").alias("away_abbr"), "value").where("value % 5 = 0")
        joined = co.join_colocated(games, stored_form, [("season", "season"), ("week", "week"), ("away_abbr", "abbr")])
        plan = plan_of(joined)
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the contests move, the form does not
        assert "Exchange" not in plan_of(stored_form.groupBy(*KEYS).agg(F.max("form")))
        plain = facts.join(form, KEYS)
        assert sorted(map(tuple, both.collect())) == sorted(map(tuple, plain.select(both.columns).collect()))
        want = games.join(form.withColumnRenamed("abbr", "away_abbr"), ["season", "week", "away_abbr"], "left")
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.select(joined.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_entity_is_spread(spark, tmp_path):
    stored = co.store_colocated(rows(spark), f"{tmp_path}/facts", KEYS, 16)
    hot = stored.where("abbr = 'A'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) > 8 and max(r["count"] for r in hot) < 400
    assert len(stored.inputFiles()) <= 16


def test_null_keys_empty_tables_and_later_sessions(spark, tmp_path):
    odd = spark.createDataFrame([(None, 1, None, 5), (2000, None, "A", 6), (2000, 1, "A", None)], "season int, week int, abbr string, `a b` int")
    stored = co.store_colocated(odd, f"{tmp_path}/odd", KEYS, 4)
    key = lambda r: tuple(map(str, r))
    assert sorted(stored.collect(), key=key) == sorted(odd.collect(), key=key)
    again = co.read_colocated(spark.newSession(), f"{tmp_path}/odd")
    assert sorted(again.collect(), key=key) == sorted(odd.collect(), key=key)
    empty = co.store_colocated(odd.where("false"), f"{tmp_path}/odd", KEYS, 4)
    assert empty.columns == odd.columns and empty.count() == 0
    assert store.newest_version(spark, f"{tmp_path}/odd").endswith("v000002")
    with pytest.raises(FileNotFoundError):
        co.read_colocated(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        co.store_colocated(odd, f"{tmp_path}/odd", ["absent"], 4)
