import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boutframe.operators.contests import numbered_schedule
from boutframe.operators.ratings import season_ratings
from boutframe.plans.domain import SPAN, Domain

SMALL = "/root/testdata/sf0.001"
ENTITIES = 6000


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """The smallest tables with so many entities that their contests are no table to broadcast."""
    root = str(tmp_path_factory.mktemp("crowded"))
    for name in ("orders", "lineitem"):
        os.symlink(f"{SMALL}/{name}.parquet", f"{root}/{name}.parquet")
    keys = spark.range(ENTITIES).withColumnRenamed("id", "s_suppkey")
    suppliers = keys.select("s_suppkey", F.lit("Supplier").alias("s_name"), F.lit(3).alias("s_nationkey"), F.lit(1.5).alias("s_acctbal"))
    suppliers.coalesce(1).write.parquet(f"{root}/supplier.parquet")
    return Domain(spark, root)


def estimate(df):
    """Bytes that the planner takes a table for, before anything has run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def half_a_megabyte(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "512k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_steps_are_those_of_the_span(spark):
    steps = Domain(spark, SMALL).steps()
    assert steps.dtypes == [("season", "int"), ("week", "int")]
    want = [(s, w) for s in range(SPAN.first, SPAN.last + 1) for w in range(1, SPAN.weeks + 1)]
    assert sorted(map(tuple, steps.collect())) == want


def test_every_step_pairs_each_entity_once(spark):
    domain = Domain(spark, SMALL)
    found = domain.pairings().select("season", "week", "away_key", "home_key").collect()
    odd, want = domain.entity_total | 1, Counter()
    for season in range(SPAN.first, SPAN.last + 1):
        for week in range(1, SPAN.weeks + 1):
            for lo in range(domain.entity_total):
                hi = (week + season * 18 - lo) % odd
                if lo < hi < domain.entity_total:
                    want[(season, week, *((lo, hi) if (lo + season + week) % 2 == 0 else (hi, lo)))] += 1
    assert Counter(map(tuple, found)) == want


def test_contests_are_not_taken_for_fewer_than_they_are(crowded):
    # Each of these rows has six fields of eight bytes at least.
    pairings, ratings = crowded.pairings(), season_ratings(crowded.ratings(), SPAN)
    n = pairings.count()
    assert n > ENTITIES * 60
    assert estimate(pairings) > n * 48
    assert estimate(ratings) > n * 48


def test_contests_are_not_broadcast_to_their_figures(crowded, half_a_megabyte):
    # The figures are few here, so those may be.
    assert "BuildLeft" not in plan_of(crowded.boxscores())


def test_game_numbers_are_not_broadcast_to_the_schedule(crowded, half_a_megabyte):
    plan = plan_of(numbered_schedule(crowded.games()))
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan
