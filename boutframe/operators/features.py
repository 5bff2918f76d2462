"""Contest features: both sides' form, differences and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe import fixed_values as fv
from boutframe.functions.calendar import SeasonSpan
from boutframe.functions.scalars import standard_code
from boutframe.operators.contests import standardise_sides
from boutframe.operators.form import entity_form

OPPONENT_FORM = [s for s in fv.FORM_STATS if s not in fv.NO_OPPONENT_FORM]
COMPARED = [*fv.FORM_STATS, *[f"opponent_{s}" for s in OPPONENT_FORM]]


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """Prefix every column but the keys."""
    return df.selectExpr(*[c if c in keys else f"{c} AS {prefix}{c}" for c in df.columns])


def join_form(schedule: DataFrame, form: DataFrame) -> DataFrame:
    """Left-join each side's form onto the schedule by step and entity code."""
    stats = form.select("season", "week", F.col("team_abbr").alias("abbr"), *COMPARED)
    for side in ("away", "home"):
        named = prefixed(stats, f"{side}_", ["season", "week"])
        schedule = schedule.join(named, ["season", "week", f"{side}_abbr"], "left")
    return schedule


def stat_differences(contests: DataFrame) -> DataFrame:
    """Away minus home for every compared stat, in one projection."""
    return contests.selectExpr("*", *[f"away_{s} - home_{s} AS {s}_diff" for s in COMPARED])


def results_of(facts: DataFrame) -> DataFrame:
    """Scores and outcome of each step and away entity."""
    return facts.select(
        "season",
        "week",
        F.col("team_name").alias("away_name"),
        F.col("team_abbr").alias("away_abbr"),
        F.col("points_scored").alias("away_score"),
        F.col("points_allowed").alias("home_score"),
        F.col("game_won").alias("result"),
    )


def join_results(contests: DataFrame, facts: DataFrame) -> DataFrame:
    """Scores and the away side's outcome, matched on the away entity's facts."""
    return contests.join(results_of(facts), ["season", "week", "away_name", "away_abbr"], "left")


def covered(schedule: DataFrame, span: SeasonSpan) -> DataFrame:
    """Contests of the span but for its first step, which no season precedes."""
    first_step = (F.col("season") == span.first) & (F.col("week") == 1)
    return schedule.where(span.covers(F.col("season"), F.col("week")) & ~first_step)


def contest_features(schedule: DataFrame, facts: DataFrame, span: SeasonSpan) -> DataFrame:
    """Pre-contest features of every contest in the span.

    ``schedule`` is the numbered schedule, ``facts`` the entity rows. The span's first
    season has no week 1, as there is no prior season to stand in.
    """
    schedule = standardise_sides(schedule)
    facts = facts.withColumn("team_abbr", standard_code(F.col("team_abbr")))
    return features_of(schedule, facts, entity_form(facts, schedule, span), span)


def features_of(schedule: DataFrame, facts: DataFrame, form: DataFrame, span: SeasonSpan) -> DataFrame:
    """:func:`contest_features` from a form at hand; all three tables have standard codes."""
    # Results first, while rows are narrow; differences last, so no exchange carries them.
    return stat_differences(join_form(join_results(covered(schedule, span), facts), form))
