"""Joining features, rankings, ratings and lines into the final table."""

from __future__ import annotations

from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe import fixed_values as fv
from boutframe.functions import calendar as cal
from boutframe.functions.scalars import modern_name
from boutframe.operators.features import prefixed
from boutframe.operators.lookups import same_group
from boutframe.operators.ratings import rating_differences
from boutframe.sources import store

COUNTED_AT_ONCE = 64


def join_rankings(contests: DataFrame, rankings: DataFrame) -> DataFrame:
    for side in ("away", "home"):
        named = prefixed(rankings, f"{side}_", ["season", "week"])
        contests = contests.join(named, ["season", "week", f"{side}_abbr"], "left")
    return contests


def join_ratings(contests: DataFrame, ratings: DataFrame) -> DataFrame:
    """Inner join on the pair and step: contests without ratings drop out."""
    keyed = ratings.withColumnsRenamed({"team1": "home_abbr", "team2": "away_abbr"})
    return contests.join(keyed, ["season", "week", "home_abbr", "away_abbr"], "inner")


def join_lines(contests: DataFrame, lines: DataFrame) -> DataFrame:
    return contests.join(lines, ["away_abbr", "home_abbr", "season", "week"], "left")


def final_layout(df: DataFrame) -> DataFrame:
    """Leading columns, the rest in alphabetical order, lines, results."""
    fixed = {*fv.FIRST_COLUMNS, *fv.LINE_COLUMNS, *fv.RESULT_COLUMNS}
    rest = sorted(c for c in df.columns if c not in fixed)
    return df.select(*fv.FIRST_COLUMNS, *rest, *fv.LINE_COLUMNS, *fv.RESULT_COLUMNS)


def combine(
    features: DataFrame,
    rankings: DataFrame,
    ratings: DataFrame,
    lines: DataFrame,
    divisions: DataFrame,
) -> DataFrame:
    """All inputs of a contest in one row, in the final layout.

    What rankings, ratings, lines and divisions add is put together on the contests' keys alone;
    the wide feature rows are then joined once. Pass written features, as they are read twice.
    """
    keys = ["season", "week", "away_abbr", "home_abbr"]
    pairs = join_ratings(features.select(*keys).distinct(), ratings)
    pairs = same_group(join_lines(rating_differences(pairs), lines), divisions)
    wide = features.join(join_rankings(pairs, rankings), keys)
    laid_out = final_layout(wide.withColumnsRenamed(fv.RATING_NAMES))
    return laid_out.withColumns(
        {name: modern_name(F.col(name)) for name in ("away_name", "home_name")}
    )


def drop_all_null(df: DataFrame, path: str | None = None) -> DataFrame:
    """Drop columns without a single value.

    With ``path``, where exactly these rows are stored as Parquet, the footers of the files tell and
    no row is read, but for columns they say nothing of. Without, pass a written table: each
    counting pass then reads its own columns only. Wide tables are counted in slices, as one
    aggregate over all columns outgrows the size the JVM compiles.
    """
    known = counts_in_footers(df.sparkSession, path) if path else {}
    counts = known | values_counted(df, [c for c in df.columns if c not in known])
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def values_counted(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Values of each column that are not null, from the rows."""
    counts: dict[str, int] = {}
    for start in range(0, len(names), COUNTED_AT_ONCE):
        some = names[start : start + COUNTED_AT_ONCE]
        row = df.agg(*[F.count(f"`{c}`").alias(c) for c in some]).first()
        counts |= dict(zip(some, row))
    return counts


def counts_in_footers(spark: SparkSession, path: str) -> dict[str, int]:
    """:func:`values_counted` of a Parquet table from the footers of its files; no row is read.

    Left out are arrays, maps, structs and variants, whose footers count what is inside them, and all
    columns asked about together with one that some file keeps no counts of. A table without files
    gives nothing.
    """
    if store.read_if_present(spark, path) is None:
        return {}
    table = footer_table(spark, path)
    plain = [f.name for f in table.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    counts: dict[str, int] = {}
    for start in range(0, len(plain), COUNTED_AT_ONCE):
        some = plain[start : start + COUNTED_AT_ONCE]
        try:
            counts |= values_counted(table, some)
        except Py4JJavaError as problem:
            # A footer without statistics: the rows have to be counted.
            if "spark.sql.parquet.aggregatePushdown" not in str(problem):
                raise
    return counts


def footer_table(spark: SparkSession, path: str) -> DataFrame:
    """The table read by the source that answers counts from footers, in a session of its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path)


def stamp_dates(df: DataFrame) -> DataFrame:
    """Date as timestamp, unreadable text to null."""
    return df.withColumn("date", F.try_to_timestamp(F.col("date").cast("string")))


def newest_first(df: DataFrame) -> DataFrame:
    """Newest first, undated last; the contest's keys make the order repeatable."""
    return df.orderBy(F.col("date").desc_nulls_last(), "season", "week", "away_abbr", "home_abbr")


def completed(all_contests: DataFrame) -> DataFrame:
    return all_contests.where(F.col("result").isNotNull())


def to_predict(all_contests: DataFrame, as_of: date) -> DataFrame:
    """Contests of the week ``as_of`` falls in that have no result."""
    today = F.lit(as_of)
    return all_contests.where(
        (F.col("season") == cal.season_of(today))
        & (F.col("week") == cal.week_of(today))
        & F.col("result").isNull()
    )
