"""Season calendar: start dates, weeks, and which season a contest id belongs to."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe import fixed_values as fv


def season_start(year: Column) -> Column:
    """The Thursday after the first Monday of September."""
    eve = F.date_sub(F.make_date(year, F.lit(9), F.lit(1)), 1)
    return F.date_add(F.next_day(eve, "MON"), 3)


def season_anchor(year: Column) -> Column:
    """The Tuesday on or before the season start, where week 1 begins."""
    return F.next_day(F.date_sub(season_start(year), 7), "TUE")


def season_of(day: Column) -> Column:
    """January and February belong to the season of the year before."""
    early = F.month(day) <= fv.SEASON_END_MONTH
    return F.year(day) - early.cast("int")


def week_of(day: Column) -> Column:
    """Week 1..18 of a date; dates from March up to the anchor count as week 1."""

    def weeks_since(anchor: Column) -> Column:
        week = F.floor(F.date_diff(day, anchor) / 7).cast("int") + 1
        return F.greatest(F.lit(1), F.least(F.lit(fv.LAST_WEEK), week))

    this_year = season_anchor(F.year(day))
    return (
        F.when(day >= this_year, weeks_since(this_year))
        .when(F.month(day) <= fv.SEASON_END_MONTH, weeks_since(season_anchor(F.year(day) - 1)))
        .when(day.isNotNull(), F.lit(1))
    )


def weeks_in_season(
    season: Column, as_of: date, include_future: bool = False
) -> Column:
    """17 before 2021, then 18; 0 for seasons not started unless ``include_future``."""
    started = F.lit(include_future) | (season <= season_of(F.lit(as_of)))
    return (
        F.when(season < fv.FIRST_SEASON_WITH_18_WEEKS, fv.WEEKS_BEFORE_2021)
        .when(started, fv.WEEKS_FROM_2021)
        .otherwise(0)
    )


def week_start(season: Column, week: Column) -> Column:
    """First day of a week: the Wednesday before the opening Thursday, then every 7 days."""
    return F.date_add(season_start(season), (week * 7 - 8).cast("int"))


def id_date(contest_id: Column) -> Column:
    """Date held by the first eight characters of a contest id, or null."""
    return F.try_to_timestamp(F.substring(contest_id, 1, 8), F.lit("yyyyMMdd")).cast("date")


def in_other_season(contest_id: Column, season: Column) -> Column:
    """True when the id's year and month rule out ``season``; unreadable ids pass."""
    year = F.substring(contest_id, 1, 4).try_cast("int")
    month = F.substring(contest_id, 5, 2).try_cast("int")
    same_year_late = (year == season) & (month >= 8)
    next_january = (year == season + 1) & (month == 1)
    readable = (F.length(contest_id) >= 8) & year.isNotNull() & month.isNotNull()
    return F.coalesce(readable & ~(same_year_late | next_january), F.lit(False))


@dataclass(frozen=True)
class SeasonSpan:
    """The contiguous seasons a job processes.

    ``weeks`` overrides the league rule with one number of weeks for every season.
    Seasons after that of ``as_of`` have not begun, so a span may not reach beyond it.
    The span fixes how many (season, week) steps can exist, whatever the data size.
    """

    first: int
    last: int
    as_of: date
    weeks: int | None = None

    def __post_init__(self):
        begun = self.as_of.year - (self.as_of.month <= fv.SEASON_END_MONTH)
        if not self.first <= self.last <= begun:
            raise ValueError(f"no span from {self.first} to {self.last}: season {begun} is the last begun by {self.as_of}")

    @property
    def max_steps(self) -> int:
        return (self.last - self.first + 1) * (self.weeks or fv.WEEKS_FROM_2021)

    def weeks_of(self, season: Column) -> Column:
        if self.weeks is not None:
            return F.lit(self.weeks)
        return weeks_in_season(season, self.as_of)

    def covers(self, season: Column, week: Column) -> Column:
        return season.between(self.first, self.last) & week.between(1, self.weeks_of(season))


def step_calendar(seasons: DataFrame, as_of: date) -> DataFrame:
    """Weeks and their start dates for each row of ``seasons`` that has begun by ``as_of``."""
    count = weeks_in_season(F.col("season"), as_of)
    return (
        seasons.where(count > 0)
        .select("season", F.explode(F.sequence(F.lit(1), count)).alias("week"))
        .withColumn("week_start", week_start(F.col("season"), F.col("week")))
    )


def in_season_dates(day: Column, span: SeasonSpan) -> Column:
    """Date within its season: first week start to seven days past the last, inclusive."""
    season = season_of(day)
    weeks = span.weeks_of(season)
    return (
        season.between(span.first, span.last)
        & (weeks > 0)
        & day.between(week_start(season, F.lit(1)), F.date_add(week_start(season, weeks), 7))
    )
