from datetime import date

import pytest
from pyspark.sql import functions as F

from boutframe.functions import calendar as cal
from boutframe.functions.calendar import SeasonSpan


@pytest.mark.parametrize(
    "year, expected",
    [(2003, (9, 4)), (2020, (9, 10)), (2021, (9, 9)), (2024, (9, 5)), (2025, (9, 4))],
)
def test_season_start(one, year, expected):
    assert one(cal.season_start(F.lit(year))) == date(year, *expected)


def test_week_one_starts_on_the_wednesday_before(one):
    assert one(cal.week_start(F.lit(2024), F.lit(1))) == date(2024, 9, 4)
    assert one(cal.week_start(F.lit(2024), F.lit(18))) == date(2025, 1, 1)


@pytest.mark.parametrize(
    "day, week",
    [
        (date(2024, 9, 2), 1),  # the Monday before the anchor
        (date(2024, 9, 3), 1),
        (date(2024, 9, 9), 1),
        (date(2024, 9, 10), 2),
        (date(2024, 12, 31), 18),
        (date(2025, 1, 6), 18),
        (date(2025, 2, 28), 18),
        (date(2025, 3, 1), 1),
        (date(2025, 7, 4), 1),
        (date(2022, 1, 4), 18),
    ],
)
def test_week_of(one, day, week):
    assert one(cal.week_of(F.lit(day))) == week


def test_week_of_matches_day_arithmetic_over_years(spark):
    days = spark.sql("SELECT explode(sequence(date'2001-01-01', date'2012-12-31')) AS day")
    rows = days.select("day", cal.week_of(F.col("day")).alias("w"), cal.season_of(F.col("day")).alias("s"))

    def opening(year):
        first = date(year, 9, 1)
        monday = first.toordinal() + (7 - first.weekday()) % 7
        return monday + 1  # the Tuesday of the opening week

    for r in rows.collect():
        d = r["day"]
        if d.toordinal() >= opening(d.year):
            expected = (d.toordinal() - opening(d.year)) // 7 + 1
        elif d.month <= 2:
            expected = (d.toordinal() - opening(d.year - 1)) // 7 + 1
        else:
            expected = 1
        assert r["w"] == max(1, min(18, expected)), d
        assert r["s"] == (d.year if d.month > 2 else d.year - 1)


def test_weeks_in_season(one):
    today = date(2024, 2, 15)
    assert one(cal.weeks_in_season(F.lit(2020), today)) == 17
    assert one(cal.weeks_in_season(F.lit(2023), today)) == 18
    assert one(cal.weeks_in_season(F.lit(2024), today)) == 0
    assert one(cal.weeks_in_season(F.lit(2024), today, include_future=True)) == 18


def test_step_calendar_covers_every_step(spark):
    span = SeasonSpan(2019, 2022, as_of=date(2022, 12, 1))
    seasons = spark.createDataFrame([(y,) for y in range(2019, 2024)], "season int")
    steps = cal.step_calendar(seasons, date(2022, 12, 1))
    assert steps.count() == 17 + 17 + 18 + 18 <= span.max_steps
    assert steps.where("season = 2021 AND week = 18").first()["week_start"] == date(2022, 1, 5)


def test_span_needs_a_date_and_ends_with_its_season(one):
    with pytest.raises(TypeError):
        SeasonSpan(2003, 2024)
    with pytest.raises(ValueError):
        SeasonSpan(2003, 2026, as_of=date(2025, 12, 31))
    span = SeasonSpan(2003, 2026, as_of=date(2027, 2, 1))  # February belongs to the season before
    assert one(span.weeks_of(F.lit(2026))) == 18
    assert one(span.covers(F.lit(2026), F.lit(18))) is True


@pytest.mark.parametrize(
    "contest, season, dropped",
    [
        ("20250112abc", 2024, False),
        ("20250209abc", 2024, True),
        ("20240211abc", 2024, True),
        ("20240905abc", 2024, False),
        ("20230905abc", 2024, True),
        ("20260101abc", 2024, True),
        ("2024", 2024, False),
        ("20x40211abc", 2024, False),
        (None, 2024, False),
    ],
)
def test_contest_in_other_season(one, contest, season, dropped):
    assert one(cal.in_other_season(F.lit(contest).cast("string"), F.lit(season))) is dropped


def test_id_date(one):
    assert one(cal.id_date(F.lit("20241103gnb"))) == date(2024, 11, 3)
    assert one(cal.id_date(F.lit("20241399gnb"))) is None
    assert one(cal.id_date(F.lit("2024"))) is None


def test_in_season_dates(one):
    span = SeasonSpan(2020, 2024, as_of=date(2025, 1, 1))
    for day, kept in [
        (date(2024, 9, 3), False),
        (date(2024, 9, 4), True),
        (date(2025, 1, 8), True),
        (date(2025, 1, 9), False),
        (date(2019, 10, 1), False),
    ]:
        assert one(cal.in_season_dates(F.lit(day), span)) is kept
