from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from boutframe import fixed_values as fv
from boutframe import schemas
from boutframe.functions.calendar import SeasonSpan
from boutframe.operators import combine as cb
from boutframe.operators import lookups as lk
from boutframe.operators import rankings as rk
from boutframe.operators import ratings as rt
from boutframe.operators import reshape as rs

SPAN = SeasonSpan(2023, 2024, as_of=date(2024, 11, 1))


# --- ratings ---------------------------------------------------------------
def ratings(spark):
    rows = [
        ("2024-09-08", 1, 0, " OAK ", "SD", "q1", "q2", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0),
        ("2024-02-11", 22, 1, "KC", "SF", "q3", "q4", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0),
        ("2023-12-31", 17, 0, "ZZZ", None, "q3", "q4", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0),
    ]
    return spark.createDataFrame(rows, schemas.RATINGS).withColumn("quality", F.lit(1))


def test_ratings_in_season_in_both_orientations(spark):
    out = rt.by_date(rt.season_ratings(ratings(spark), SPAN))
    rows = out.collect()
    assert "quality" not in out.columns
    assert len(rows) == 4  # the February contest is after its season's last week
    assert {(r["season"], r["team1"], r["team2"]) for r in rows} == {
        (2024, "LV", "LAC"), (2024, "LAC", "LV"), (2023, "ZZZ", None), (2023, None, "ZZZ"),
    }
    swapped = next(r for r in rows if r["team1"] == "LAC")
    assert (swapped["qb1"], swapped["elo1_pre"], swapped["qbelo2_pre"], swapped["qb1_value_pre"]) == ("q2", 2.0, 3.0, 6.0)
    assert [r["date"] for r in rows] == sorted(r["date"] for r in rows)


def test_unreadable_rating_dates_raise(spark):
    bad = ratings(spark).withColumn("date", F.lit("soon"))
    with pytest.raises(Exception, match="CANNOT_PARSE|CAST_INVALID|could not be parsed"):
        rt.season_ratings(bad, SPAN).collect()


def test_rating_differences_are_away_minus_home(spark):
    r = rt.rating_differences(ratings(spark)).first()
    assert (r["elo_dif"], r["qb_elo_dif"], r["qb_dif"]) == (1.0, 1.0, 1.0)


# --- rankings --------------------------------------------------------------
RAW = [
    (2024, 1, "home_rating", "New England (10-3-1)", "1.5"),
    (2024, 1, "away_rating", "New England (10-3-1)", "--"),
    (2024, 1, "home_rating", "Elsewhere (1-0)", "2"),
    (2024, 1, "turnover_margin_per_game", "Green Bay", "-0.5"),
    (2024, 2, "home_rating", "Green Bay (2-0)", "4"),
    (2024, 3, "home_rating", "Green Bay (3-0)", "9"),
    (2023, 2, "home_rating", "Green Bay (2-0)", "7"),
]


def raw_rankings(spark):
    return spark.createDataFrame(RAW, schemas.RANKINGS_RAW)


def test_metrics_pivot_like_full_joins(spark):
    values = rk.ranking_values(raw_rankings(spark))
    metrics = ["home_rating", "away_rating", "turnover_margin_per_game"]
    wide = rk.pivot_metrics(values, metrics)
    joined = rk.join_metrics(values, metrics).select(wide.columns)
    assert wide.exceptAll(joined).count() == 0 == joined.exceptAll(wide).count()
    r = wide.where("week = 1 AND abbr = 'NE'").first()
    assert (r["home_rating"], r["away_rating"], r["turnover_margin_per_game"]) == (1.5, 0.0, None)
    assert wide.where("abbr = 'Elsewhere'").count() == 1


def test_current_week_is_carried_forward(spark):
    out = rk.season_rankings(raw_rankings(spark), SPAN, 2024, current_week=2)
    later = {r["week"]: r["home_rating"] for r in out.where("season = 2024 AND week >= 2").collect()}
    assert later == {w: 4.0 for w in range(2, 19)}  # week 3's own row gives way
    assert out.where("season = 2023").count() == 1
    assert out.where("away_rating IS NULL").count() == 0


def test_last_known_value_fills_gaps(spark):
    rows = [("a", 1, 5.0), ("a", 2, None), ("a", 3, 7.0), ("b", 1, None), ("b", 2, 1.0)]
    df = spark.createDataFrame(rows, "e string, w int, v double")
    out = {(r["e"], r["w"]): r["v"] for r in rk.last_known(df, ["e"], "w", ["v"]).collect()}
    assert out == {("a", 1): 5.0, ("a", 2): 5.0, ("a", 3): 7.0, ("b", 1): None, ("b", 2): 1.0}


def test_html_items(spark):
    pages = [
        (1, "<p>x</p><ul class='a'>\n<li><a href='#'>12.5</a></li><li> Two\nlines </li></ul><ul><li>no</li></ul>"),
        (2, "<p>no list</p>"),
        (3, "<ulx><li>no</li></ulx><UL><LI>b</LI ><link><li>NaN</li><Li>7</lI></UL >"),
    ]
    df = spark.createDataFrame(pages, "page int, html string")
    rows = [tuple(r) for r in rk.html_items(df).orderBy("page", "pos").collect()]
    assert rows == [(1, 0, "12.5", 12.5), (1, 1, "Two\nlines", 0.0), (3, 0, "b", 0.0), (3, 1, "NaN", 0.0), (3, 2, "7", 7.0)]


def test_html_items_inside_items(spark):
    pages = [
        (1, "<!-- <ul><li>no</li></ul> --><ul><li>a<ul><li>1</li><li>2</li></ul></li><li>b</li></ul><ul><li>no</li></ul>"),
        (2, "</ul></li><UL id=x><LI>a<ol><li>5</li></ol> c</LI><!-- </ul> --><li>7</li></Ul>"),
        (3, "<ul><li>never closed</li>"),
        (4, "<ul><li>open<li>closed</li></ul>"),
        (5, "<ulx><li>no</li></ulx><ul\n><link><li/>x</li></ul>"),
        (6, None),
        (7, ""),
        (8, "<ul>" * 40 + "<li>deep</li>" + "</ul>" * 40),
    ]
    df = spark.createDataFrame(pages, "page int, html string")
    rows = [tuple(r)[:3] for r in rk.html_items(df).orderBy("page", "pos").collect()]
    assert rows == [
        (1, 0, "a12"), (1, 1, "1"), (1, 2, "2"), (1, 3, "b"), (2, 0, "a5 c"), (2, 1, "5"), (2, 2, "7"),
        (4, 0, "closed"), (5, 0, "x"), (8, 0, "deep"),
    ]


# --- lookups and final table -----------------------------------------------
def test_divisions(spark):
    pairs = [("WSH", "DAL"), ("WSH", "NE"), ("X1", "X2"), ("X1", "NE")]
    df = spark.createDataFrame(pairs, "away_abbr string, home_abbr string")
    flagged = lk.same_group(df, lk.league_divisions(spark)).collect()
    out = {(r["away_abbr"], r["home_abbr"]): r["division"] for r in flagged}
    assert out == {("WSH", "DAL"): 1, ("WSH", "NE"): 0, ("X1", "X2"): 1, ("X1", "NE"): 0}


def test_broadcast_only_below_the_bound(spark):
    def broadcast(rows):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            joined = spark.range(100).join(lk.small_enough(spark.range(10), rows, columns=1), "id")
            return "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    assert broadcast(rows=10)
    assert not broadcast(rows=lk.BROADCAST_CELLS + 1)


def test_translate_misses(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    lookup = spark.createDataFrame([("a", "A")], "alias string, abbr string")
    assert {r["c"] for r in lk.translate(df, "c", lookup).collect()} == {"A", "z", None}
    kept = lk.translate(df, "c", lookup, into="d", on_miss="null").collect()
    assert {(r["c"], r["d"]) for r in kept} == {("a", "A"), ("z", None), (None, None)}


def contests(spark):
    names = [*fv.FIRST_COLUMNS, "zeta", "alpha", "empty", *fv.LINE_COLUMNS, *fv.RESULT_COLUMNS]
    rows = []
    for i, (day, season, week, result) in enumerate(
        [("2024-09-08", 2024, 1, 1.0), (None, 2024, 9, None), ("2024-10-31", 2024, 9, None), ("2024-11-10", 2024, 10, None)]
    ):
        values = dict.fromkeys(names)
        values.update(away_name="Oakland Raiders", home_name="B", away_abbr=f"a{i}", home_abbr="b", season=season,
                      week=week, date=day, zeta=1.0, result=result)
        rows.append(tuple(values[n] for n in reversed(names)))
    kinds = {"season": "int", "week": "int", "result": "double", "zeta": "double", "empty": "double"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in reversed(names))
    return spark.createDataFrame(rows, schema)


def test_layout_empty_columns_and_order(spark):
    laid = cb.final_layout(contests(spark))
    assert laid.columns == [*fv.FIRST_COLUMNS, "alpha", "empty", "zeta", *fv.LINE_COLUMNS, *fv.RESULT_COLUMNS]
    kept = cb.drop_all_null(laid)
    assert "empty" not in kept.columns and "zeta" in kept.columns
    dates = [r["date"] for r in cb.newest_first(cb.stamp_dates(kept)).collect()]
    assert dates == [datetime(2024, 11, 10), datetime(2024, 10, 31), datetime(2024, 9, 8), None]


def test_outputs(spark):
    table = contests(spark)
    assert [r["away_abbr"] for r in cb.completed(table).collect()] == ["a0"]
    predict = cb.to_predict(table, date(2024, 10, 30)).collect()  # a Wednesday in week 9
    assert {r["away_abbr"] for r in predict} == {"a1", "a2"}


# --- nested ------------------------------------------------------------------
def test_flatten_and_table(spark):
    people = {"00-1": {"draft": "263", "name": "M H"}, "00-2": {"draft": "1", "name": "X"}}
    df = spark.createDataFrame([(1, people)], "id int, m map<string, map<string, string>>")
    flat = {tuple(r["path"]): r["leaf"] for r in rs.flatten_map(df, "m", ["id"]).collect()}
    assert flat == {(k, n): v for k, inner in people.items() for n, v in inner.items()}
    for names in (None, ["draft", "name"]):
        table = rs.nested_table(df, "m", ["id"], names)
        assert {(r["path"][0], r["draft"], r["name"]) for r in table.collect()} == {
            ("00-1", "263", "M H"), ("00-2", "1", "X"),
        }


def test_flatten_depths(spark):
    flat = spark.createDataFrame([(1, {"a": 5})], "id int, m map<string, int>")
    assert [tuple(r) for r in rs.flatten_map(flat, "m", ["id"]).collect()] == [(1, ["a"], 5)]
    plain = spark.createDataFrame([(1, 7)], "id int, m int")
    assert [tuple(r) for r in rs.flatten_map(plain, "m", ["id"]).collect()] == [(1, [], 7)]


def test_null_columns_from_footers(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4).select(
        "id", F.lit(None).cast("double").alias("none"), F.when(F.col("id") > 900, "x").alias("a.b c"),
        F.array(F.lit(None).cast("int")).alias("list"), F.lit(None).cast("array<int>").alias("no_list"),
        F.when(F.col("id") < 5, F.lit(float("nan"))).alias("nan"), (F.col("id") % 2).alias("part"),
    )
    path = f"{tmp_path}/t"
    rows.write.partitionBy("part").parquet(path)
    table = cb.footer_table(spark, path)
    plan = table.agg(F.count("none"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(none)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    counts = cb.counts_in_footers(spark, path)
    assert counts == {"id": 1000, "none": 0, "a.b c": 99, "nan": 5, "part": 1000}
    stored = spark.read.parquet(path)
    assert cb.drop_all_null(stored, path).columns == ["id", "a.b c", "list", "nan", "part"]
    assert cb.drop_all_null(stored).columns == ["id", "a.b c", "list", "nan", "part"]


def test_null_columns_where_footers_tell_nothing(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"x": pa.array([1, None]), "y": pa.array([None, None], pa.int64())})
    pq.write_table(table, f"{tmp_path}/plain.parquet", write_statistics=False)
    stored = spark.read.parquet(f"{tmp_path}/plain.parquet")
    assert cb.counts_in_footers(spark, f"{tmp_path}/plain.parquet") == {}
    assert cb.drop_all_null(stored, f"{tmp_path}/plain.parquet").columns == ["x"]
    assert cb.counts_in_footers(spark, f"{tmp_path}/absent") == {}


def test_variants_of_any_depth(spark):
    deep = '{"a": ' * 30 + "1" + "}" * 30
    texts = [(1, '{"a": {"b": 1, "c": [2, {"d": "x"}]}, "e": null}'), (2, "5"), (3, "{}"), (4, None), (5, deep), (6, "[[], [null]]"), (6, "5")]
    df = spark.createDataFrame(texts, "id int, text string").select("id", F.parse_json("text").alias("v"))
    out = rs.flatten_variant(df, "v", ["id"]).select("id", F.array_join("path", "/"), F.col("leaf").cast("string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        (1, "a/b", "1"), (1, "a/c/0", "2"), (1, "a/c/1/d", "x"), (1, "e", None), (2, "", "5"),
        (5, "/".join("a" * 30), "1"), (6, "1/0", None), (6, "", "5"),
    ], key=str)
    whole = rs.flatten_variant(df.where("id = 6"), "v", ["id"], arrays=False).select(F.to_json("leaf"))
    assert sorted(r[0] for r in whole.collect()) == ["5", "[[],[null]]"]
    assert rs.flatten_variant(df.where("false"), "v", ["id"]).count() == 0
