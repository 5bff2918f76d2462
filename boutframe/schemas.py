"""Declared schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T

from boutframe import fixed_values as fv


def _fields(kind: T.DataType, names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


STEP = [T.StructField("season", T.IntegerType()), T.StructField("week", T.IntegerType())]

GAMES = T.StructType(
    [
        T.StructField("boxscore_id", T.StringType()),
        *STEP,
        *_fields(T.StringType(), ["away_name", "away_abbr"]),
        T.StructField("away_score", T.DoubleType()),
        *_fields(T.StringType(), ["home_name", "home_abbr"]),
        T.StructField("home_score", T.DoubleType()),
    ]
)

BOXSCORES = T.StructType(
    [
        T.StructField("boxscore_id", T.StringType()),
        *[
            T.StructField(
                f"{side}_{stat}",
                T.StringType() if stat == "time_of_possession" else T.DoubleType(),
            )
            for side in ("away", "home")
            for stat in fv.BOXSCORE_STATS
        ],
    ]
)

SCHEDULE_RECORD = T.StructType(
    [*_fields(T.StringType(), ["away_name", "away_abbr", "home_name", "home_abbr"]), *STEP]
)

LINES = T.StructType(
    [
        *STEP,
        *_fields(T.StringType(), ["home_team", "away_team"]),
        *_fields(
            T.DoubleType(),
            [
                "home_spread_last", "home_spread_last_price", "away_spread_last_price",
                "home_spread_open", "home_spread_open_price", "away_spread_open_price",
                "total_line_last", "under_price_last", "over_price_last",
                "total_line_open", "under_price_open", "over_price_open",
                "home_ml_last", "away_ml_last", "home_ml_open", "away_ml_open",
            ],
        ),
    ]
)

RATINGS = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("week", T.IntegerType()),
        T.StructField("neutral", T.IntegerType()),
        *_fields(T.StringType(), ["team1", "team2", "qb1", "qb2"]),
        *_fields(
            T.DoubleType(),
            [
                "elo1_pre", "elo2_pre", "qbelo1_pre", "qbelo2_pre",
                "qb1_value_pre", "qb2_value_pre",
            ],
        ),
    ]
)

RANKINGS_RAW = T.StructType([*STEP, *_fields(T.StringType(), ["metric", "label", "value"])])

DIVISIONS = T.StructType(_fields(T.StringType(), ["abbr", "division"]))

CODES = T.StructType(_fields(T.StringType(), ["alias", "abbr"]))
