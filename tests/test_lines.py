import pytest
from pyspark.sql import Observation

from boutframe import schemas
from boutframe.operators import lines as ln

NAMES = schemas.LINES.names


def line(**values):
    base = dict.fromkeys(NAMES)
    base.update(season=2024, week=1, home_team="OAK", away_team="LV")
    base.update({k: v if isinstance(v, (str, int)) else float(v) for k, v in values.items()})
    return tuple(base[n] for n in NAMES)


@pytest.fixture
def chosen(spark):
    def run(**values):
        df = spark.createDataFrame([line(**values)], schemas.LINES)
        return ln.with_moneylines(ln.with_choices(df)).first()

    return run


def test_last_quote_wins_when_plausible(chosen):
    r = chosen(home_spread_last=-3.0, home_spread_open=-1.0, home_spread_last_price=-400.0, total_line_last=41.5)
    assert (r["home_spread"], r["away_spread"], r["spread_source"]) == (-3.0, 3.0, "last")
    assert (r["total_line"], r["total_line_source"]) == (41.5, "last")
    assert (r["home_moneyline"], r["away_moneyline"]) == (-158.0, 129.0)


def test_opening_quote_stands_in(chosen):
    r = chosen(
        home_spread_last=-3.0, away_spread_last_price=401.0, home_spread_open=2.5,
        total_line_open=50.0, home_ml_open=120.0, home_ml_last=-999.0,
    )
    assert (r["home_spread"], r["spread_source"], r["total_line"]) == (2.5, "open", 50.0)
    assert r["moneyline_source"] == "open"
    assert r["home_moneyline"] == 120.0


def test_defaults(chosen):
    r = chosen(
        home_spread_last=9.0, home_spread_last_price=500.0, total_line_last=60.0, over_price_last=-401.0,
        home_ml_last=-110.0,
    )
    assert (r["home_spread"], r["spread_source"]) == (0.0, "default")
    assert (r["total_line"], r["total_line_source"]) == (44.0, "default")
    assert (r["home_moneyline"], r["away_moneyline"]) == (90.0, 90.0)


def test_open_total_alone_moves_the_moneyline_source(chosen):
    r = chosen(home_spread_last=1.0, total_line_open=44.0, home_ml_last=-1.0, home_ml_open=-2.0)
    assert (r["spread_source"], r["moneyline_source"], r["home_moneyline"]) == ("last", "open", -2.0)


def test_validity_and_counts(spark):
    rows = [
        line(home_spread_last=1.0, total_line_last=40.0, home_ml_last=-120.0, away_ml_last=100.0),
        line(home_spread_open=1.0, total_line_last=40.0),
        line(home_spread_last=1.0),
        line(total_line_open=40.0),
        line(home_spread_last=1.0, home_spread_last_price=900.0, total_line_last=40.0),
    ]
    df = spark.createDataFrame(rows, schemas.LINES)
    assert ln.valid_lines(df).count() == 3
    assert ln.line_quality(df).first().asDict() == {
        "rows_seen": 5, "rejected": 2, "default_spreads": 1, "default_totals": 0,
        "computed_home_moneylines": 2, "computed_away_moneylines": 2,
    }


def test_season_lines_layout_and_codes(spark):
    rows = [line(home_spread_last=1.0, total_line_last=40.0), line(season=2023, home_spread_last=1.0, total_line_last=40.0)]
    out = ln.season_lines(spark.createDataFrame(rows, schemas.LINES), season=2024).collect()
    assert len(out) == 1
    assert out[0].asDict()["home_abbr"] == "LV"  # from OAK
    assert out[0]["away_abbr"] is None  # LV is not among the known spellings
    lookup = spark.createDataFrame([("LV", "X1"), ("OAK", "X2")], "alias string, abbr string")
    both = ln.season_lines(spark.createDataFrame(rows, schemas.LINES), lookup).collect()
    assert {(r["away_abbr"], r["home_abbr"]) for r in both} == {("X1", "X2")}


def test_sides_mirror(spark):
    rows = [line(home_spread_last=s / 2, total_line_last=40.0) for s in range(-30, 31)]
    out = ln.season_lines(spark.createDataFrame(rows, schemas.LINES)).collect()
    assert all(r["away_spread"] == -r["home_spread"] for r in out)
    by_spread = {r["home_spread"]: r["home_moneyline"] for r in out}
    assert all(r["away_moneyline"] == by_spread[r["away_spread"]] for r in out)


def test_counts_come_with_the_write_and_without_another_scan(spark, tmp_path):
    good = {"home_spread_last": -3.0, "total_line_last": 41.5}
    rows = [line(), line(**good), line(**good, home_ml_last=-150.0), line(home_spread_open=2.0, total_line_open=40.0)]
    spark.createDataFrame(rows, schemas.LINES).write.parquet(f"{tmp_path}/quotes")
    quotes = spark.read.parquet(f"{tmp_path}/quotes")
    counts = Observation("quality")
    out = ln.season_lines(quotes, quality=counts)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and plan.count("Relation [") == 1
    out.write.parquet(f"{tmp_path}/lines")
    assert counts.get == ln.line_quality(quotes).first().asDict()
    plain = ln.season_lines(quotes)
    stored = spark.read.parquet(f"{tmp_path}/lines")
    assert plain.exceptAll(stored).count() == 0 == stored.exceptAll(plain).count()
