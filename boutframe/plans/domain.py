"""Contest tables derived from the star schema.

Suppliers act as entities, so contests, facts and ratings grow with the data:
``lineitem`` gives box scores, ``orders`` gives scores and betting lines. The first
entities carry the fixed team codes in their various spellings; the rest have codes
of their own, which every lookup leaves alone or misses.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutframe import fixed_values as fv
from boutframe.functions import calendar as cal
from boutframe.functions.calendar import SeasonSpan

AS_OF = date(2001, 11, 14)
SPAN = SeasonSpan(first=1995, last=2001, weeks=18, as_of=AS_OF)
FIRST_DAY, LAST_DAY = f"{SPAN.first}-01-01", f"{SPAN.last}-12-31 23:59:59"
NAMED = 32  # entities that carry a fixed team code
LEGACY_NAMES = list(fv.MODERN_NAMES)
PLACES = {code: place for place, code in fv.PLACE_CODES.items()}
LABELS = [PLACES[code] for code in fv.STANDARD_CODES[:NAMED]]
METRICS = [*fv.RANKING_RATINGS, *fv.RANKING_STATS]


def pick(items: list[str], position: Column) -> Column:
    """The item at a zero-based position, null when out of range."""
    return F.try_element_at(F.array(*[F.lit(i) for i in items]), (position + 1).cast("int"))


def own_code(key: Column) -> Column:
    return F.concat(F.lit("E"), key.cast("string"))


def raw_code(key: Column) -> Column:
    """Box-score spelling for the named entities, an own code for the rest."""
    return F.coalesce(F.when(key < NAMED, pick(fv.BOXSCORE_CODES, key)), own_code(key))


def market_code(key: Column) -> Column:
    return F.coalesce(F.when(key < NAMED, pick(fv.RATING_CODES, key)), own_code(key))


def clean_code(key: Column) -> Column:
    return F.coalesce(F.when(key < NAMED, pick(fv.STANDARD_CODES, key)), own_code(key))


def entity_name(key: Column) -> Column:
    legacy = F.when(key < len(LEGACY_NAMES), pick(LEGACY_NAMES, key))
    return F.coalesce(legacy, F.concat(F.lit("Entity "), key.cast("string")))


def step_of(ts: Column) -> tuple[Column, Column]:
    """Season and week of a business date: the year in slices of twenty days."""
    week = F.floor((F.dayofyear(ts) - 1) / 20).cast("int") + 1
    return F.year(ts).alias("season"), F.least(F.lit(18), week).alias("week")


@dataclass
class Domain:
    """Contest tables over one directory of Parquet tables."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # --- entities and pairings --------------------------------------------
    @cached_property
    def entity_total(self) -> int:
        """Number of entities: the one value taken from the data when a plan is built."""
        return self.table("supplier").agg(F.max("s_suppkey")).first()[0] + 1

    def foe_of(self, key: Column, season: Column, week: Column) -> Column:
        """Round-robin opponent: keys add up to the step modulo an odd number."""
        odd = self.entity_total | 1
        return F.pmod(week + season * 18 - key, F.lit(odd))

    def steps(self) -> DataFrame:
        """Season and week of every step of the span."""
        step, weeks = F.col("id"), SPAN.weeks
        numbered = self.spark.range((SPAN.last - SPAN.first + 1) * weeks)
        season = F.lit(SPAN.first) + F.floor(step / weeks)
        return numbered.select(season.cast("int").alias("season"), (step % weeks + 1).cast("int").alias("week"))

    def pairings(self) -> DataFrame:
        """One row per contest: season, week, away and home key, date, contest id."""
        # Spread the keys before each becomes 126 rows. A join counts in the planner's estimate of their
        # size, which is above the true one; an explode does not, and so many rows would be broadcast.
        keys = self.table("supplier").select(F.col("s_suppkey").alias("lo"))
        spread = keys.repartition(self.spark.sparkContext.defaultParallelism, "lo")
        steps = spread.crossJoin(F.broadcast(self.steps()))
        lo, season, week = F.col("lo"), F.col("season"), F.col("week")
        paired = steps.withColumn("hi", self.foe_of(lo, season, week)).where(
            (lo < F.col("hi")) & (F.col("hi") < self.entity_total)
        )
        lower_away = (lo + season + week) % 2 == 0
        away = F.when(lower_away, lo).otherwise(F.col("hi"))
        home = F.when(lower_away, F.col("hi")).otherwise(lo)
        day = F.date_add(cal.season_start(season), ((week - 1) * 7 + lo % 4).cast("int"))
        return paired.select(
            season,
            week,
            away.alias("away_key"),
            home.alias("home_key"),
            day.alias("day"),
            F.concat(F.date_format(day, "yyyyMMdd"), raw_code(home)).alias("boxscore_id"),
        )

    # --- box scores and scores --------------------------------------------
    def entity_stats(self) -> DataFrame:
        """The box-score figures per season, week and entity key, whole-valued."""
        items = self.table("lineitem").where(
            F.col("l_shipdate").between(FIRST_DAY, LAST_DAY)
        )
        season, week = step_of(F.col("l_shipdate"))
        ret, acc, done = (
            F.col("l_returnflag") == "R",
            F.col("l_returnflag") == "A",
            F.col("l_linestatus") == "F",
        )
        base = items.groupBy(season, week, F.col("l_suppkey").alias("key")).agg(
            F.count("*").alias("n"),
            F.sum("l_quantity").cast("long").alias("qty"),
            F.sum("l_linenumber").alias("lines"),
            F.sum(F.col("l_partkey") % 100).alias("parts"),
            F.sum(F.col("l_orderkey") % 10).alias("digits"),
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"),
            F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"),
            F.max("l_quantity").cast("long").alias("most"),
            F.min("l_quantity").cast("long").alias("least"),
            F.count_if(ret).alias("ret"),
            F.count_if(acc).alias("acc"),
            F.count_if(done).alias("done"),
            F.count_if(acc & done).alias("both"),
        )
        seconds = F.expr("(qty * 13 + n * 7) % 3600")
        stats = {
            "first_downs": F.expr("n + lines"),
            "rush_attempts": F.col("lines"),
            "rush_yards": F.col("parts"),
            "rush_touchdowns": F.col("ret"),
            "pass_completions": F.expr("n + acc"),
            "pass_attempts": F.expr("2 * n + lines"),
            "pass_yards": F.col("qty"),
            "pass_touchdowns": F.col("done"),
            "interceptions": F.col("disc"),
            "times_sacked": F.col("digits"),
            "yards_lost_from_sacks": F.expr("digits * 7"),
            "net_pass_yards": F.expr("qty - digits"),
            "total_yards": F.expr("qty + parts"),
            "fumbles": F.col("tax"),
            "fumbles_lost": F.expr("least(tax, n)"),
            "turnovers": F.expr("disc + tax"),
            "penalties": F.col("most"),
            "yards_from_penalties": F.expr("most * 5 + least"),
            "third_down_conversions": F.col("ret"),
            "third_down_attempts": F.col("n"),
            "fourth_down_conversions": F.col("both"),
            "fourth_down_attempts": F.col("acc"),
        }
        clock = F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)
        return base.select(
            "season", "week", "key",
            *[value.cast("double").alias(name) for name, value in stats.items()],
            clock.alias("time_of_possession"),
        )

    def entity_scores(self) -> DataFrame:
        """Points per season, week and entity key, from the orders of its customers."""
        season, week = step_of(F.col("o_orderdate"))
        key = (F.col("o_custkey") % self.entity_total).alias("key")
        points = F.sum(F.floor("o_totalprice")) % 60
        return (
            self.table("orders")
            .where(F.col("o_orderdate").between(FIRST_DAY, LAST_DAY))
            .select(season, week, key, "o_totalprice")
            .groupBy("season", "week", "key")
            .agg(points.cast("double").alias("points"))
        )

    def _both_sides(self, sides: DataFrame, how: str) -> DataFrame:
        """Pairings joined with a per-entity table once per side, columns prefixed."""
        out = self.pairings()
        for side in ("away", "home"):
            named = sides.select(
                "season", "week",
                *[
                    F.col(c).alias(f"{side}_{c}")
                    for c in sides.columns if c not in ("season", "week")
                ],
            )
            out = out.join(named, ["season", "week", f"{side}_key"], how)
        return out

    def games(self) -> DataFrame:
        """Wide contests; scores are null where unknown or later than ``AS_OF``."""
        scored = self._both_sides(self.entity_scores(), "left")

        def known(points: str) -> Column:
            return F.when(F.col("day") <= F.lit(AS_OF), F.col(points))

        return scored.select(
            "boxscore_id", "season", "week",
            entity_name(F.col("away_key")).alias("away_name"),
            raw_code(F.col("away_key")).alias("away_abbr"),
            known("away_points").alias("away_score"),
            entity_name(F.col("home_key")).alias("home_name"),
            raw_code(F.col("home_key")).alias("home_abbr"),
            known("home_points").alias("home_score"),
        )

    def boxscores(self) -> DataFrame:
        """Wide box scores by contest id, where both sides have figures."""
        wide = self._both_sides(self.entity_stats(), "inner")
        return wide.select(
            "boxscore_id",
            *[f"{side}_{s}" for side in ("away", "home") for s in fv.BOXSCORE_STATS],
        )

    # --- ratings -----------------------------------------------------------
    def ratings(self) -> DataFrame:
        """Raw ratings, a row per contest, codes in mixed spellings.

        Some contests have none, some have the away side first, some a date out of season.
        """
        away, home, week = F.col("away_key"), F.col("home_key"), F.col("week")
        first = F.when((away + home * 2) % 5 == 0, away).otherwise(home)
        second = away + home - first
        day = F.when((away + home) % 31 == 0, F.date_add("day", 200)).otherwise(F.col("day"))

        def padded(key: Column) -> Column:
            return F.when(key % 3 == 0, F.concat(F.lit(" "), market_code(key), F.lit(" "))).otherwise(
                market_code(key)
            )

        def figures(key: Column, n: int) -> list[Column]:
            return [
                (1300 + (key * 37 + week * 11) % 400).cast("double").alias(f"elo{n}_pre"),
                (1310 + (key * 41 + week * 13) % 380).cast("double").alias(f"qbelo{n}_pre"),
                ((key * 7 + week * 3) % 250).cast("double").alias(f"qb{n}_value_pre"),
                F.concat(F.lit("QB "), (key % 97).cast("string")).alias(f"qb{n}"),
            ]

        return self.pairings().where((away + home + week) % 29 != 0).select(
            F.date_format(day, "yyyy-MM-dd").alias("date"),
            "season",
            week,
            F.when((away + home) % 10 == 0, 1).otherwise(0).alias("neutral"),
            F.lit(None).cast("string").alias("playoff"),
            padded(first).alias("team1"),
            padded(second).alias("team2"),
            *figures(first, 1),
            *figures(second, 2),
            F.lit(None).cast("double").alias("surface_factor"),
        )

    # --- lines ---------------------------------------------------------------
    def quotes(self) -> DataFrame:
        """Raw line quotes, one per order, with gaps and implausible prices."""
        season, week = step_of(F.col("o_orderdate"))
        base = self.table("orders").select(
            season, week, "o_orderkey", "o_custkey",
            (F.col("o_custkey") % self.entity_total).alias("key"),
            F.floor("o_totalprice").cast("long").alias("cents"),
        )
        key, foe = F.col("key"), F.col("foe")
        paired = base.withColumn("foe", self.foe_of(key, F.col("season"), F.col("week"))).where(
            (foe < self.entity_total) & (foe != key)
        )
        lower_away = (F.least(key, foe) + F.col("season") + F.col("week")) % 2 == 0
        lo, hi = F.least(key, foe), F.greatest(key, foe)
        return paired.select(
            "season", "week", "o_orderkey",
            market_code(F.when(lower_away, hi).otherwise(lo)).alias("home_team"),
            market_code(F.when(lower_away, lo).otherwise(hi)).alias("away_team"),
            *[F.expr(rule).alias(name) for name, rule in QUOTE_RULES.items()],
            F.lit("feed").alias("ml_last_source"),
        )

    def closing_quotes(self) -> DataFrame:
        """The last quote of each contest."""
        # One buffer of doubles per column keeps the aggregate hashed, where a struct would sort.
        latest = [F.max_by(c, "o_orderkey").alias(c) for c in QUOTE_RULES]
        keys = ["season", "week", "home_team", "away_team"]
        return self.quotes().groupBy(*keys).agg(F.max("o_orderkey").alias("o_orderkey"), *latest)

    def code_lookup(self) -> DataFrame:
        """Market spelling to standard code per entity; some entities are not listed."""
        key = F.col("s_suppkey")
        return (
            self.table("supplier")
            .where(key % 17 != 5)
            .select(market_code(key).alias("alias"), clean_code(key).alias("abbr"))
        )

    def divisions(self) -> DataFrame:
        """Entity code to group; some entities belong to none."""
        key = F.col("s_suppkey")
        return (
            self.table("supplier")
            .where(F.col("s_nationkey") < 20)
            .select(
                clean_code(key).alias("abbr"),
                F.concat(F.lit("D"), (F.col("s_nationkey") % 8).cast("string")).alias("division"),
            )
        )

    # --- rankings ------------------------------------------------------------
    def rankings_raw(self) -> DataFrame:
        """Long ranking entries with decorated labels and text values.

        The current season has entries up to the current week only.
        """
        season, week = step_of(F.col("l_shipdate"))
        items = self.table("lineitem").where(
            F.col("l_shipdate").between(FIRST_DAY, LAST_DAY)
        )
        key, total = F.col("key"), F.col("total")
        place = F.coalesce(F.when(key < NAMED, pick(LABELS, key)), own_code(key))
        rated = F.col("m") < len(fv.RANKING_RATINGS)
        record = F.when(
            total % 4 == 0, F.format_string(" (%d-%d-1)", total % 12, total % 5)
        ).otherwise(F.format_string(" (%d-%d)", total % 12, total % 5))
        return (
            items.groupBy(
                season, week, F.col("l_suppkey").alias("key"),
                (F.col("l_partkey") % len(METRICS)).cast("int").alias("m"),
            )
            .agg(F.sum("l_quantity").cast("long").alias("total"))
            .where((F.col("season") < AS_OF.year) | (F.col("week") <= CURRENT_WEEK))
            .select(
                "season", "week",
                pick(METRICS, F.col("m")).alias("metric"),
                F.when(rated, F.concat(place, record)).otherwise(place).alias("label"),
                F.when(total % 11 == 0, "--")
                .when(total % 13 == 0, "NaN")
                .when(total % 17 == 0, "1.5d")
                .when(total % 19 == 0, "Infinity")
                .otherwise((total / 4).cast("string"))
                .alias("value"),
            )
        )


CURRENT_WEEK = 11

QUOTE_RULES = {
    "home_spread_last": "case when o_orderkey % 5 = 0 then null else (o_custkey % 41 - 20) / 2.0D end",
    "home_spread_last_price": "case when o_orderkey % 7 = 0 then null else cast(cents % 900 - 450 as double) end",
    "away_spread_last_price": "case when o_orderkey % 11 = 0 then null else cast(cents % 820 - 410 as double) end",
    "home_spread_open": "case when o_orderkey % 6 = 0 then null else (o_custkey % 37 - 18) / 2.0D end",
    "home_spread_open_price": "case when o_orderkey % 9 = 0 then null else cast(cents % 840 - 420 as double) end",
    "away_spread_open_price": "case when o_orderkey % 8 = 0 then null else cast(cents % 810 - 405 as double) end",
    "total_line_last": "case when o_orderkey % 4 = 0 then null else 35 + cents % 40 / 2.0D end",
    "under_price_last": "case when o_orderkey % 10 = 0 then null else cast(cents % 870 - 435 as double) end",
    "over_price_last": "case when o_orderkey % 13 = 0 then null else cast(cents % 830 - 415 as double) end",
    "total_line_open": "case when o_orderkey % 14 = 0 then null else 36 + cents % 38 / 2.0D end",
    "under_price_open": "case when o_orderkey % 12 = 0 then null else cast(cents % 850 - 425 as double) end",
    "over_price_open": "case when o_orderkey % 15 = 0 then null else cast(cents % 815 - 407 as double) end",
    "home_ml_last": "case when o_orderkey % 3 = 0 then null else cast(cents % 600 - 300 as double) end",
    "away_ml_last": "case when o_orderkey % 16 = 0 then null else cast(cents % 500 - 250 as double) end",
    "home_ml_open": "case when o_orderkey % 17 = 0 then null else cast(cents % 640 - 320 as double) end",
    "away_ml_open": "case when o_orderkey % 18 < 4 then null else cast(cents % 560 - 280 as double) end",
}
