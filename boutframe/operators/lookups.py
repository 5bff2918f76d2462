"""Lookup joins and the size rule for broadcasting."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe import fixed_values as fv
from boutframe.functions.scalars import any_standard_code

BROADCAST_CELLS = 4_000_000


def small_enough(side: DataFrame, rows: int, columns: int) -> DataFrame:
    """Broadcast ``side`` only when its proven row bound is small.

    ``rows`` must be a bound known without looking at the data (a calendar span, a
    fixed list). Beyond the limit the join is left to the optimizer, which measures
    both sides at run time.
    """
    return F.broadcast(side) if rows * columns <= BROADCAST_CELLS else side


def translate(
    df: DataFrame,
    column: str,
    lookup: DataFrame,
    into: str | None = None,
    on_miss: Literal["keep", "null"] = "keep",
) -> DataFrame:
    """Replace codes through a two-column lookup table (alias, code).

    For lookups that grow with the data; it is an ordinary left join whose strategy
    follows the measured size. Aliases must be unique.
    """
    alias, code = lookup.columns
    keyed = lookup.select(F.col(alias).alias("__alias"), F.col(code).alias("__code"))
    joined = df.join(keyed, df[column] == keyed["__alias"], "left")
    value = F.col("__code") if on_miss == "null" else F.coalesce("__code", F.col(column))
    return joined.withColumn(into or column, value).drop("__alias", "__code")


def league_divisions(spark) -> DataFrame:
    """The fixed division list as (abbr, division), codes standardised."""
    rows = [(code, division) for division, codes in fv.DIVISIONS.items() for code in codes]
    listed = spark.createDataFrame(rows, "abbr string, division string")
    return listed.withColumn("abbr", any_standard_code(F.col("abbr")))


def same_group(df: DataFrame, groups: DataFrame, name: str = "division") -> DataFrame:
    """Flag 1 where both sides fall in the same group; two unlisted sides count as equal."""
    member, group = groups.columns
    for side in ("away", "home"):
        keyed = groups.select(
            F.col(member).alias(f"{side}_abbr"), F.col(group).alias(f"__{side}_group")
        )
        df = df.join(keyed, f"{side}_abbr", "left")
    flag = F.col("__away_group").eqNullSafe(F.col("__home_group")).cast("int")
    return df.withColumn(name, flag).drop("__away_group", "__home_group")
