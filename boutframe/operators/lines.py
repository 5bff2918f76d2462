"""Betting lines: validity, choice between quotes, moneylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from boutframe import fixed_values as fv
from boutframe.functions.odds import lower_tail, moneyline
from boutframe.functions.scalars import rating_code
from boutframe.operators.lookups import translate


def plausible(price: Column) -> Column:
    """A missing price passes; a present one must lie within +-400."""
    limit = fv.MAX_PLAUSIBLE_PRICE
    return price.isNull() | price.between(-limit, limit)


def has_spread_and_total() -> Column:
    spread = F.coalesce("home_spread_last", "home_spread_open")
    total = F.coalesce("total_line_last", "total_line_open")
    return spread.isNotNull() & total.isNotNull()


def valid_lines(lines: DataFrame) -> DataFrame:
    return lines.where(has_spread_and_total())


def choose(last: str, last_prices: list[str], opened: str, open_prices: list[str], default: float):
    """The last quote if usable, else the opening one, else a default; with its source."""

    def usable(line: str, prices: list[str]) -> Column:
        ok = F.col(line).isNotNull()
        for price in prices:
            ok = ok & plausible(F.col(price))
        return ok

    use_last, use_open = usable(last, last_prices), usable(opened, open_prices)
    value = F.when(use_last, F.col(last)).when(use_open, F.col(opened)).otherwise(F.lit(default))
    source = F.when(use_last, "last").when(use_open, "open").otherwise("default")
    return value, source


def with_choices(lines: DataFrame) -> DataFrame:
    """Spread, total and moneyline source of every line, with where each came from."""
    spread, spread_source = choose(
        "home_spread_last", ["home_spread_last_price", "away_spread_last_price"],
        "home_spread_open", ["home_spread_open_price", "away_spread_open_price"],
        fv.DEFAULT_SPREAD,
    )
    total, total_source = choose(
        "total_line_last", ["under_price_last", "over_price_last"],
        "total_line_open", ["under_price_open", "over_price_open"],
        fv.DEFAULT_TOTAL,
    )
    chosen = lines.withColumns(
        {
            "home_spread": spread,
            "spread_source": spread_source,
            "total_line": total,
            "total_line_source": total_source,
        }
    )
    any_open = (F.col("spread_source") == "open") | (F.col("total_line_source") == "open")
    return chosen.withColumns(
        {
            "away_spread": F.lit(0.0) - F.col("home_spread"),
            "moneyline_source": F.when(any_open, "open").otherwise(F.col("spread_source")),
        }
    )


def quoted_moneyline(side: str) -> Column:
    """The side's quote from the moneyline source; null when missing or defaulted."""
    source = F.col("moneyline_source")
    return F.when(source == "last", F.col(f"{side}_ml_last")).when(
        source == "open", F.col(f"{side}_ml_open")
    )


def with_moneylines(chosen: DataFrame) -> DataFrame:
    """Quoted moneylines, computed from the side's spread where there is no quote.

    Both sides' spreads are equally far from zero, so one tail serves both.
    """
    tailed = chosen.withColumn(
        "__distance", F.abs(F.col("home_spread")) / fv.MARGIN_STD_DEV
    ).withColumn("__tail", lower_tail(F.col("__distance")))
    lines = {
        f"{side}_moneyline": F.coalesce(
            quoted_moneyline(side), moneyline(F.col(f"{side}_spread"), F.col("__tail"))
        )
        for side in ("home", "away")
    }
    return tailed.withColumns(lines).drop("__distance", "__tail")


def with_abbreviations(lines: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Both sides' standard codes, unknown teams null.

    Uses the fixed code list, or a (alias, abbr) table where entities outnumber it.
    """
    if codes is None:
        return lines.withColumns(
            {f"{s}_abbr": rating_code(F.col(f"{s}_team")) for s in ("home", "away")}
        )
    for side in ("home", "away"):
        lines = translate(lines, f"{side}_team", codes, into=f"{side}_abbr", on_miss="null")
    return lines


def quality_counts() -> list[Column]:
    """Counts over lines with their choices and ``ok``: rejected, defaulted and computed ones."""
    return [
        F.count("*").alias("rows_seen"),
        F.count_if(~F.col("ok")).alias("rejected"),
        F.count_if(F.col("ok") & (F.col("spread_source") == "default")).alias("default_spreads"),
        F.count_if(F.col("ok") & (F.col("total_line_source") == "default")).alias("default_totals"),
        *[
            F.count_if(F.col("ok") & quoted_moneyline(side).isNull()).alias(f"computed_{side}_moneylines")
            for side in ("home", "away")
        ],
    ]


def line_quality(lines: DataFrame) -> DataFrame:
    """Counts of rejected, defaulted and computed lines, in a pass of their own."""
    return with_choices(lines).withColumn("ok", has_spread_and_total()).agg(*quality_counts())


def season_lines(
    lines: DataFrame,
    codes: DataFrame | None = None,
    season: int | None = None,
    quality: Observation | None = None,
) -> DataFrame:
    """Final lines per contest in the fixed layout; one season or all at once.

    ``quality`` takes the counts of :func:`line_quality` while the result is written, so that the
    quotes are read once; its values are there when the first action on the result has ended.
    """
    kept = lines.drop(*fv.LINE_DROPS)
    if season is not None:
        kept = kept.where(F.col("season") == season)
    if quality is None:
        chosen = with_choices(valid_lines(kept))
    else:
        judged = with_choices(kept).withColumn("ok", has_spread_and_total())
        chosen = judged.observe(quality, *quality_counts()).where("ok").drop("ok")
    return with_moneylines(with_abbreviations(chosen, codes)).select(*fv.LINE_LAYOUT)
