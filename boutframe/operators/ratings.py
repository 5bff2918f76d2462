"""Pre-contest ratings of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe import fixed_values as fv
from boutframe.functions import calendar as cal
from boutframe.functions.calendar import SeasonSpan
from boutframe.functions.scalars import any_standard_code

SWAP = {a: b for pair in fv.RATING_PAIRS for a, b in (pair, pair[::-1])}


def both_orientations(ratings: DataFrame) -> DataFrame:
    """Every row and its mirror with the two sides swapped, so either order matches.

    One scan: each row is exploded into its two orientations.
    """

    def oriented(swap: dict[str, str]):
        return F.struct(*[F.col(swap.get(c, c)).alias(c) for c in ratings.columns])

    pair = F.array(oriented({}), oriented(SWAP))
    return ratings.select(F.explode(pair).alias("row")).select("row.*")


def season_ratings(ratings: DataFrame, span: SeasonSpan) -> DataFrame:
    """In-season ratings with standard codes, in both orientations, with their season.

    The season comes from the date, not from a column. Dates must be readable.
    """
    dated = ratings.drop(*fv.RATING_DROPS).withColumn("date", F.to_date("date"))
    kept = dated.where(cal.in_season_dates(F.col("date"), span)).withColumns(
        {t: any_standard_code(F.col(t)) for t in ("team1", "team2")}
    )
    return both_orientations(kept).withColumn("season", cal.season_of(F.col("date")))


def by_date(ratings: DataFrame) -> DataFrame:
    """Oldest first; team codes break ties so the order is repeatable."""
    return ratings.orderBy("date", "team1", "team2")


def rating_differences(contests: DataFrame) -> DataFrame:
    """Side 2 minus side 1, that is away minus home."""
    return contests.withColumns(
        {
            "elo_dif": F.col("elo2_pre") - F.col("elo1_pre"),
            "qb_dif": F.col("qb2_value_pre") - F.col("qb1_value_pre"),
            "qb_elo_dif": F.col("qbelo2_pre") - F.col("qbelo1_pre"),
        }
    )
