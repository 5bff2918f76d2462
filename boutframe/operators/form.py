"""Pre-contest form: expanding history, prior-season fallback, rates, shrinkage.

The history of an entity before week ``w`` is everything it did earlier in the
season, or its whole prior season where there is nothing yet. Facts are first summed
per (season, entity, week) with a map-side combine; all later steps work on those
few rows, so one entity holding a large share of the facts stays one small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe import fixed_values as fv
from boutframe.functions.calendar import SeasonSpan
from boutframe.functions.scalars import guarded_rate
from boutframe.operators.contests import appearances
from boutframe.operators.lookups import small_enough
from boutframe.session import written

ENTITY = ["team_name", "team_abbr"]
NOT_AVERAGED = {*fv.RATIO_INPUTS, *ENTITY, "week", "season", "game_number"}
STEP_COLUMNS = {"season", "week", "first_listed", "next_seen", "next_listed", "next_week"}
RATES = {
    "win_perc": ("game_won", None, fv.DEFAULT_WIN),
    "third_down_perc": ("third_down_conversions", "third_down_attempts", fv.DEFAULT_THIRD_DOWN),
    "fourth_down_perc": ("fourth_down_conversions", "fourth_down_attempts", fv.DEFAULT_FOURTH_DOWN),
    "opponent_third_down_perc": (
        "opponent_third_down_conversions", "opponent_third_down_attempts", fv.DEFAULT_THIRD_DOWN,
    ),
    "opponent_fourth_down_perc": (
        "opponent_fourth_down_conversions", "opponent_fourth_down_attempts", fv.DEFAULT_FOURTH_DOWN,
    ),
}


# --- column sets -----------------------------------------------------------
def with_ratio_inputs(facts: DataFrame) -> DataFrame:
    """Add missing ratio inputs as 0.0."""
    missing = [c for c in fv.RATIO_INPUTS if c not in facts.columns]
    return facts.withColumns({c: F.lit(0.0) for c in missing}) if missing else facts


def averaged_columns(facts: DataFrame) -> list[str]:
    """All numeric columns that are neither keys nor ratio inputs, sorted."""
    numeric = {f.name for f in facts.schema if isinstance(f.dataType, T.NumericType)}
    return sorted(numeric - NOT_AVERAGED)


# --- one group-by ----------------------------------------------------------
def ratio_sums(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the ratio inputs; only-null sums are 0, rows without an entity drop."""
    usable = with_ratio_inputs(facts).dropna(subset=[k for k in keys if k in ENTITY])
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in fv.RATIO_INPUTS]
    return usable.groupBy(*keys).agg(*sums)


def stat_means(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Null-skipping means of every averaged column."""
    usable = facts.dropna(subset=[k for k in keys if k in ENTITY])
    return usable.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in averaged_columns(facts)])


def rate(name: str) -> Column:
    part, whole, default = RATES[name]
    total = F.col(whole) if whole else F.col("game_won") + F.col("game_lost")
    return guarded_rate(F.col(part), total, default)


def with_rates(sums: DataFrame) -> DataFrame:
    return sums.withColumns({name: rate(name) for name in RATES})


# --- history ---------------------------------------------------------------
def weekly_totals(facts: DataFrame, span: SeasonSpan) -> DataFrame:
    """Sum and non-null count of each stat per season, entity and week."""
    filled = with_ratio_inputs(facts)
    means = averaged_columns(filled)
    usable = filled.dropna(subset=ENTITY).where(span.covers(F.col("season"), F.col("week")))
    return usable.groupBy("season", *ENTITY, "week").agg(
        *[F.expr(f"sum({c}) AS {c}__sum") for c in [*fv.RATIO_INPUTS, *means]],
        *[F.expr(f"count({c}) AS {c}__n") for c in means],
    )


def first_listings(schedule: DataFrame, span: SeasonSpan) -> DataFrame:
    """First scheduled week per season and entity code."""
    listed = appearances(schedule).where(span.covers(F.col("season"), F.col("week")))
    return (
        listed.dropna(subset=["team_abbr"])
        .groupBy("season", "team_abbr")
        .agg(F.min("week").alias("listed"))
    )


def running_form(weekly: DataFrame, listings: DataFrame) -> DataFrame:
    """Form after each week, with what is needed to know which steps it serves.

    Listing rows travel with the weekly rows, so one shuffle and one sort by entity
    code feed all windows, and nothing is joined. A group holds at most one row per
    step of the span and entity name, whatever the size of the data.
    """
    sums = [c for c in weekly.columns if c.endswith("__sum")]
    counts = [c for c in weekly.columns if c.endswith("__n")]
    means = sorted(c[: -len("__n")] for c in counts)
    by_week = "PARTITION BY team_abbr, season, team_name ORDER BY week"
    so_far = f"({by_week} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    in_season = W.partitionBy("team_abbr", "season")
    next_season = W.partitionBy("team_abbr").orderBy("season").rangeBetween(1, 1)

    rows = weekly.unionByName(listings, allowMissingColumns=True).repartition("team_abbr")
    running = rows.selectExpr(
        "season", *ENTITY, "week", "listed",
        f"lead(week) OVER ({by_week}) AS next_week",
        *[f"sum({c}) OVER {so_far} AS {c}" for c in [*sums, *counts]],
    )
    form = with_rates(
        running.selectExpr(
            "season", *ENTITY, "week", "listed", "next_week",
            *[f"coalesce({c}__sum, 0.0D) AS {c}" for c in fv.RATIO_INPUTS],
            *[f"try_divide({c}__sum, {c}__n) AS {c}" for c in means],
        )
    )
    placed = form.select(
        "*",
        F.min("week").over(in_season).alias("first_seen"),
        F.min("listed").over(in_season).alias("first_listed"),
    )
    return (
        placed.select(
            "*",
            F.min("first_seen").over(next_season).alias("next_seen"),
            F.min("first_listed").over(next_season).alias("next_listed"),
        )
        .where(F.col("week").isNotNull())
        .drop("listed", "first_seen")
    )


def steps_served(running: DataFrame, span: SeasonSpan) -> DataFrame:
    """Spread each running row over the steps whose pre-contest form it is.

    Within its season a row serves the weeks after its own, up to the next row; this
    covers bye weeks without an entity-by-week grid. The last row of a season also
    stands in next season: in week 1 always, and while the entity is on the schedule
    without facts of its own yet. ``starting`` marks an entity's first scheduled week.
    """
    season, week = F.col("season"), F.col("week")
    own = F.struct(
        season.alias("season"),
        (week + 1).alias("from_week"),
        F.coalesce(F.col("next_week"), span.weeks_of(season)).alias("to_week"),
        F.lit(False).alias("from_prior"),
        F.col("first_listed").alias("start_week"),
    )
    weeks_next = span.weeks_of(season + 1)
    stands_in = F.col("next_week").isNull() & (season < span.last) & (weeks_next > 0)
    until = F.when(F.col("next_listed").isNull(), 1).otherwise(F.least("next_seen", weeks_next))
    prior = F.struct(
        (season + 1).alias("season"),
        F.lit(1).alias("from_week"),
        F.when(stands_in, until).otherwise(0).alias("to_week"),
        F.lit(True).alias("from_prior"),
        F.col("next_listed").alias("start_week"),
    )
    stats = [c for c in running.columns if c not in STEP_COLUMNS]
    return (
        running.select(*stats, F.explode(F.array(own, prior)).alias("use"))
        .where("use.from_week <= use.to_week")
        .select(
            "use.season",
            F.explode(F.sequence("use.from_week", "use.to_week")).alias("week"),
            *stats,
            "use.from_prior",
            F.col("use.start_week").alias("start_week"),
        )
        .withColumn("starting", F.coalesce(F.col("week") == F.col("start_week"), F.lit(False)))
        .drop("start_week")
    )


def raw_form(facts: DataFrame, schedule: DataFrame, span: SeasonSpan) -> DataFrame:
    """Form of every entity before every step, before shrinkage."""
    running = running_form(weekly_totals(facts, span), first_listings(schedule, span))
    return steps_served(running, span)


def league_means(form: DataFrame) -> DataFrame:
    """Mean over entities of each stat per step; one row per step of the span."""
    stats = averaged_columns(form)
    return form.groupBy("season", "week").agg(*[F.expr(f"avg({s}) AS league_{s}") for s in stats])


def shrink_first_games(form: DataFrame, span: SeasonSpan) -> DataFrame:
    """Pull entities a third of the way to the league mean before their first contest.

    ``form`` is read twice; pass a written table where recomputing it is dear.
    """
    stats = averaged_columns(form)
    # One row per step, and the span fixes the number of steps.
    league = small_enough(league_means(form), rows=span.max_steps, columns=len(stats) + 2)
    pull = fv.SHRINK_TO_LEAGUE
    kept = [c for c in form.columns if c not in stats and c != "starting"]
    return form.join(league, ["season", "week"], "left").selectExpr(
        *kept,
        *[
            f"CASE WHEN starting THEN {pull!r}D * league_{s} + {1 - pull!r}D * {s} ELSE {s} END AS {s}"
            for s in stats
        ],
    )


def entity_form(
    facts: DataFrame, schedule: DataFrame, span: SeasonSpan, write: bool = True
) -> DataFrame:
    """Form of every entity before every step, shrunk before first contests.

    The unshrunk form is written once, as the league means and the result both read it.
    """
    form = raw_form(facts, schedule, span)
    return shrink_first_games(written(form, "form") if write else form, span)


def entities_without_history(facts: DataFrame, schedule: DataFrame, span: SeasonSpan) -> DataFrame:
    """Scheduled entities with no facts before a step (weeks after the first)."""
    seasons = span.weeks_of(F.col("season"))
    listed = appearances(schedule).select("season", "team_abbr").distinct()
    steps = listed.withColumn("week", F.explode(F.sequence(F.lit(1), seasons))).where("week > 1")
    first = (
        facts.where(span.covers(F.col("season"), F.col("week")))
        .groupBy("season", "team_abbr")
        .agg(F.min("week").alias("first_week"))
    )
    earlier = (
        (steps["season"] == first["season"])
        & (steps["team_abbr"] == first["team_abbr"])
        & (first["first_week"] < steps["week"])
    )
    return steps.join(first, earlier, "left_anti")
