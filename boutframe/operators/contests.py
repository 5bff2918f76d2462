"""Wide contests to entity rows, box-score attachment, schedules and game numbers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutframe import fixed_values as fv
from boutframe.functions import calendar as cal
from boutframe.functions import scalars as sc

SIDES = ("away", "home")
UNWANTED_OPPONENT = ("opponent_points_allowed", "opponent_time_of_possession")


def other(side: str) -> str:
    return "home" if side == "away" else "away"


def drop_other_seasons(contests: DataFrame, contest_id: str = "boxscore_id") -> DataFrame:
    """Drop contests whose id belongs to another season than their ``season`` column."""
    return contests.where(~cal.in_other_season(F.col(contest_id), F.col("season")))


def stats_usable(as_of: date) -> Column:
    """Not scheduled after ``as_of`` and at least one score known."""
    day = cal.id_date(F.col("boxscore_id"))
    scored = F.col("away_score").isNotNull() | F.col("home_score").isNotNull()
    return ~F.coalesce(day > F.lit(as_of), F.lit(False)) & scored


def attach_boxscores(games: DataFrame, boxscores: DataFrame, as_of: date) -> DataFrame:
    """Left-join box scores by id; contests without usable stats keep null stats.

    The usability test is part of the join condition, so future and unscored contests
    find no match instead of being joined and blanked. Their ids stay as join keys:
    nulling them would send every such contest to one task.
    """
    wanted = [f"{side}_{stat}" for side in SIDES for stat in fv.BOXSCORE_STATS]
    stats = boxscores.select(F.col("boxscore_id").alias("stats_id"), *wanted)
    match = (F.col("boxscore_id") == F.col("stats_id")) & stats_usable(as_of)
    return games.join(stats, match, "left").drop("stats_id")


def side_row(side: str, with_stats: bool) -> Column:
    """One side of a wide contest as a struct with side-neutral names."""
    foe = other(side)
    own_score, foe_score = F.col(f"{side}_score"), F.col(f"{foe}_score")
    both = sc.played(own_score, foe_score)
    won = sc.outcome(own_score, foe_score)
    fields = [
        F.col(f"{side}_name").alias("team_name"),
        F.col(f"{side}_abbr").alias("team_abbr"),
        F.when(both, own_score).alias("points_scored"),
        F.when(both, foe_score).alias("points_allowed"),
        won.alias("game_won"),
        (1 - won).alias("game_lost"),
    ]
    if with_stats:
        for owner, prefix in ((side, ""), (foe, "opponent_")):
            named = {prefix + stat: F.col(f"{owner}_{stat}") for stat in fv.BOXSCORE_STATS}
            clock = f"{prefix}time_of_possession"
            named[clock] = sc.clock_seconds(named[clock])
            fields += [v.alias(n) for n, v in named.items() if n not in UNWANTED_OPPONENT]
    return F.struct(*fields)


def entity_rows(contests: DataFrame, with_stats: bool = True) -> DataFrame:
    """Two rows per contest, own figures plus the other side's as ``opponent_*``.

    One scan and no shuffle: each row is exploded into its two sides.
    """
    sides = F.array(*[side_row(side, with_stats) for side in SIDES])
    return contests.select("season", "week", F.explode(sides).alias("side")).select(
        "side.*", "week", "season"
    )


def team_games(games: DataFrame, boxscores: DataFrame, as_of: date) -> DataFrame:
    """Entity facts for every contest of every season (placeholders included)."""
    valid = drop_other_seasons(games)
    return entity_rows(attach_boxscores(valid, boxscores, as_of))


def side_stats(boxscores: DataFrame, side: str, stats: list[str]) -> DataFrame:
    """One side of wide box scores with the side's prefix taken off."""
    return boxscores.select(
        "boxscore_id",
        F.lit(side).alias("side"),
        *[F.col(f"{side}_{stat}").alias(stat) for stat in stats],
    )


def opponent_mirror(entity_stats: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """Long form of the mirror: add the other side's stats to each side's row.

    ``entity_stats`` has one row per contest (``keys``) and ``side``.
    """
    foes = entity_stats.select(
        *keys,
        F.when(F.col("side") == "away", "home").otherwise("away").alias("side"),
        *[F.col(s).alias(f"opponent_{s}") for s in stats],
    )
    return entity_stats.join(foes, [*keys, "side"], "left")


def standardise_sides(contests: DataFrame) -> DataFrame:
    return contests.withColumns(
        {f"{side}_abbr": sc.standard_code(F.col(f"{side}_abbr")) for side in SIDES}
    )


def appearances(schedule: DataFrame) -> DataFrame:
    """One row per contest and side: season, week, team_name, team_abbr."""
    sides = F.array(
        *[
            F.struct(F.col(f"{s}_name").alias("team_name"), F.col(f"{s}_abbr").alias("team_abbr"))
            for s in SIDES
        ]
    )
    return schedule.select("season", "week", F.explode(sides).alias("side")).select(
        "season", "week", "side.*"
    )


def game_numbers(schedule: DataFrame) -> DataFrame:
    """Each entity's running contest number by week, from 1, over both sides.

    Appearances are counted per week first, with a map-side combine, so the window
    sees at most one row per week however busy an entity is.
    """
    weekly = appearances(schedule).groupBy("season", "team_abbr", "week").agg(F.count("*").alias("n"))
    earlier = (
        W.partitionBy("season", "team_abbr").orderBy("week").rangeBetween(W.unboundedPreceding, -1)
    )
    number = F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1
    return weekly.select("season", "week", "team_abbr", number.cast("int").alias("game_number"))


def numbered_schedule(games: DataFrame) -> DataFrame:
    """Schedule with the game number of both sides."""
    schedule = drop_other_seasons(games).select(
        "away_name", "away_abbr", "home_name", "home_abbr", "season", "week"
    )
    numbers = game_numbers(schedule)
    for side in SIDES:
        renamed = numbers.withColumnsRenamed(
            {"team_abbr": f"{side}_abbr", "game_number": f"{side}_game_number"}
        )
        schedule = schedule.join(renamed, ["season", "week", f"{side}_abbr"], "left")
    return schedule.select(
        "away_name", "away_abbr", "home_name", "home_abbr", "season", "week",
        "away_game_number", "home_game_number",
    )
