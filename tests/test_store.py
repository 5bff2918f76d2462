import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe import schemas
from boutframe.session import shared_folder, written
from boutframe.sources import store


def test_materialize_reads_builds_and_refreshes(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return spark.range(len(calls)).withColumn("x", F.lit(1.5))

    assert store.materialize(spark, path, build).count() == 1
    assert store.materialize(spark, path, build).count() == 1 and len(calls) == 1
    assert store.materialize(spark, path, build, force=True).count() == 2
    assert store.materialize(spark, path, build).count() == 2 and len(calls) == 2


def test_materialize_rebuilds_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.materialize(spark, path, lambda: spark.range(0)).count() == 0
    assert store.materialize(spark, path, lambda: spark.range(3)).count() == 3


def test_materialize_may_read_the_version_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    first = store.materialize(spark, path, lambda: spark.range(3))
    again = store.materialize(spark, path, lambda: first.unionAll(first), force=True)
    assert again.count() == 6


def test_failed_build_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    store.materialize(spark, path, lambda: spark.range(3))
    broken = spark.range(5).select(F.raise_error(F.lit("boom")).cast("long").alias("id"))
    with pytest.raises(Exception, match="boom"):
        store.materialize(spark, path, lambda: broken, force=True)
    assert store.materialize(spark, path, lambda: spark.range(9)).count() == 3


def test_csv_round_trip_and_index_column(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(",season,name,x\n0,2024,a,1.5\n1,2023,,\n")
    df = store.read_csv(spark, str(path), "season int, name string, x double")
    assert [tuple(r) for r in df.orderBy("season").collect()] == [(2023, None, None), (2024, "a", 1.5)]
    store.write_csv(df, str(tmp_path / "deep" / "out"))
    back = store.read_csv(spark, str(tmp_path / "deep" / "out"), df.schema, index=False)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_missing_csv_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        store.read_csv(spark, str(tmp_path / "none.csv"), "a int")


def test_first_existing_source(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Unnamed: 0,team1,x\n0,KC,1\n")
    (tmp_path / "c.csv").write_text("team1,x\nSF,2\n")
    paths = [None, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path / "c.csv")]
    assert store.read_first_csv(spark, paths).columns == ["team1", "x"]
    assert store.read_first_csv(spark, paths[3:]).first()["team1"] == "SF"
    (tmp_path / "d.csv").write_text(",team1\n0,KC\n")
    assert store.read_first_csv(spark, [str(tmp_path / "d.csv")]).columns == ["team1"]
    declared = store.read_first_csv(spark, paths[2:], T.StructType.fromDDL("team1 string, x double"))
    assert declared.columns == ["team1", "x"] and declared.first()["x"] == 1.0
    with pytest.raises(FileNotFoundError):
        store.read_first_csv(spark, paths[:2])


def test_read_lines(spark, tmp_path):
    names = schemas.LINES.names
    (tmp_path / "l.csv").write_text(",".join(names) + "\n" + ",".join(["2024", "1", "KC", "SF"] + ["1.5"] * (len(names) - 4)) + "\n")
    row = store.read_lines(spark, str(tmp_path / "l.csv"), schemas.LINES).first()
    assert (row["season"], row["home_team"], row["home_spread_last"]) == (2024, "KC", 1.5)


def test_refresh_touches_only_due_partitions(spark, tmp_path):
    path, today = str(tmp_path / "p"), date(2024, 9, 25)  # week 4
    steps = spark.sql("SELECT s AS season, w AS week, 1 AS v FROM (SELECT explode(array(2023, 2024)) AS s) LATERAL VIEW explode(sequence(1, 6)) AS w")
    store.refresh_partitions(steps, path, F.lit(True))
    newer = steps.withColumn("v", F.lit(2))
    store.refresh_partitions(newer, path, store.due_for_refresh(today))
    rows = spark.read.parquet(path).where("v = 2").select("season", "week").collect()
    assert sorted(map(tuple, rows)) == [(2024, 3), (2024, 4), (2024, 5)]
    assert spark.read.parquet(path).count() == 12
    assert newer.where(store.due_for_refresh(today, skip_current=True)).count() == 0
    assert newer.where(store.due_for_refresh(today, force=True)).count() == 12


def test_emptied_partitions_are_removed(spark, tmp_path):
    path, today = str(tmp_path / "p"), date(2024, 9, 25)  # week 4: weeks 3 to 5 are due
    steps = spark.sql("SELECT 2024 AS season, explode(sequence(1, 6)) AS week, 1 AS v")
    store.refresh_partitions(steps, path, F.lit(True))
    fewer = steps.where("week <> 5 AND week <> 6").withColumn("v", F.lit(2))
    due = store.due_for_refresh(today)
    store.refresh_partitions(store.rows_to_refresh(fewer, spark.read.parquet(path), due), path, F.lit(True), due)
    rows = {r["week"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert rows == {1: 1, 2: 1, 3: 2, 4: 2, 6: 1}  # week 6 is not due


def test_missing_partitions_are_refreshed_too(spark, tmp_path):
    path, today = str(tmp_path / "p"), date(2024, 9, 25)
    steps = spark.sql("SELECT 2024 AS season, explode(sequence(1, 6)) AS week, 1 AS v")
    store.refresh_partitions(steps, path, F.col("week") != 1)
    due = store.due_for_refresh(today)
    rows = store.rows_to_refresh(steps, spark.read.parquet(path), due)
    assert sorted(r["week"] for r in rows.collect()) == [1, 3, 4, 5]


def test_records_and_nan(spark):
    df = store.from_records(spark, [{"season": 2024, "week": 1, "away_abbr": "a"}], schemas.SCHEDULE_RECORD)
    assert df.first()["home_abbr"] is None and df.schema == schemas.SCHEDULE_RECORD
    nan = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, i int")
    assert [r["x"] for r in store.no_nan(nan).orderBy("i").collect()] == [None, 2.0]


def test_written_tables_live_in_the_named_folder(spark):
    out = written(spark.range(5), "five")
    assert out.count() == 5
    assert shared_folder(spark) in out.inputFiles()[0]


def test_of_two_builds_at_once_one_is_stored_and_one_fails(spark, tmp_path):
    path, meet = f"file://{tmp_path}/stage", threading.Barrier(2)
    store.materialize(spark, path, lambda: spark.range(1).withColumn("who", F.lit("first")))

    def build(who):
        def rows():
            meet.wait(60)  # both have seen the same current version
            return spark.range(500).withColumn("who", F.lit(who))

        try:
            return store.materialize(spark, path, rows, force=True).select("who").distinct().collect()[0][0]
        except store.VersionTaken as taken:
            return taken

    with ThreadPoolExecutor(2) as pool:
        results = list(pool.map(build, ("a", "b")))
    won = [r for r in results if isinstance(r, str)]
    assert len(won) == 1 and sum(isinstance(r, store.VersionTaken) for r in results) == 1
    stored = spark.read.parquet(store.newest_version(spark, path))
    assert stored.groupBy("who").count().collect() == [(won[0], 500)]
    assert sorted(p.name for p in (tmp_path / "stage").iterdir()) == ["v000001", "v000002"]


def test_a_failed_build_leaves_the_old_version_and_no_folder(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    store.materialize(spark, path, lambda: spark.range(3))
    with pytest.raises(Exception):
        store.materialize(spark, path, lambda: spark.range(9).select(F.raise_error(F.lit("lost"))), force=True)
    assert spark.read.parquet(store.newest_version(spark, path)).count() == 3
    assert [p.name for p in (tmp_path / "stage").iterdir()] == ["v000001"]


def test_records_of_json_lists(spark):
    rows = [(1, '[{"a": 1, "b": "x", "more": 5}, {"b": "y"}]'), (2, "[]"), (3, None), (4, "no list"), (5, '[{"a": 2}]')]
    out = store.records_in(spark.createDataFrame(rows, "id int, j string"), "j", "a int, b string").collect()
    assert [tuple(r) for r in out] == [(1, 1, "x"), (1, None, "y"), (5, 2, None)]
