"""The query catalogue: one Spark query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe import fixed_values as fv
from boutframe.functions import calendar as cal
from boutframe.functions import distributions as dist
from boutframe.functions import scalars as sc
from boutframe.learning import kept, sampling, scaling, search
from boutframe.learning import model as ml
from boutframe.operators import combine as cb
from boutframe.operators import contests as ct
from boutframe.operators import features as ft
from boutframe.operators import form as fm
from boutframe.operators import lines as ln
from boutframe.operators import lookups as lk
from boutframe.operators import rankings as rk
from boutframe.operators import ratings as rt
from boutframe.operators import reshape as rs
from boutframe.operators.kept_form import KeptForm
from boutframe.plans.domain import AS_OF, CURRENT_WEEK, SPAN, Domain, clean_code, pick
from boutframe.plans.jobs import Build, Inputs
from boutframe.session import shared_folder, written
from boutframe.sources import colocated as co
from boutframe.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ENTITY_SEASON = ["season", *fm.ENTITY]
MIRRORED = fv.BOXSCORE_STATS
CODE_POOL = [*fv.BOXSCORE_CODES[:32], *fv.CODE_ALIASES, "XXX"]
CALENDAR_AS_OF = date(2024, 2, 15)
LINE_ITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles half to even, as sums in different orders differ in the last bits.

    ``rint`` keeps this to two multiplications; ``round`` goes through decimals.
    """
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    scale = f"1e{digits}D"
    return df.selectExpr(
        *[f"rint(`{c}` * {scale}) / {scale} AS `{c}`" if c in doubles else f"`{c}`" for c in df.columns]
    )


def build(spark: SparkSession, root: str) -> Build:
    d = Domain(spark, root)
    inputs = Inputs(
        games=d.games(),
        boxscores=d.boxscores(),
        ratings=d.ratings(),
        rankings_raw=d.rankings_raw(),
        lines=d.closing_quotes(),
        divisions=d.divisions(),
        codes=d.code_lookup(),
    )
    return Build(inputs, SPAN, current_season=AS_OF.year, current_week=CURRENT_WEEK)


# --- contests --------------------------------------------------------------
@query
def team_games(spark, root):
    """Two rows per contest with outcomes; unplayed contests stay as placeholders."""
    games = ct.drop_other_seasons(Domain(spark, root).games())
    return ct.entity_rows(games, with_stats=False)


@query
def opponent_mirror(spark, root):
    """Own and opponent stats side by side, from long rows."""
    boxes = Domain(spark, root).boxscores()
    away, home = (ct.side_stats(boxes, side, MIRRORED) for side in ct.SIDES)
    return ct.opponent_mirror(away.unionByName(home), ["boxscore_id"], MIRRORED)


@query
def game_numbers(spark, root):
    """Running contest number per entity and season."""
    return ct.game_numbers(ct.drop_other_seasons(Domain(spark, root).games()))


@query
def schedule(spark, root):
    """Schedule with both sides' contest numbers."""
    return ct.numbered_schedule(Domain(spark, root).games())


@query
def win_pct_diff(spark, root):
    """The shortest path end to end: pre-contest win rates and their difference."""
    played = ct.drop_other_seasons(Domain(spark, root).games())
    games = written(ct.standardise_sides(played), "played")  # read by facts, schedule and result
    form = fm.raw_form(ct.entity_rows(games, with_stats=False), games, SPAN)
    rates = form.select("season", "week", F.col("team_abbr").alias("abbr"), "win_perc")
    contests = games.select("season", "week", "away_abbr", "home_abbr")
    for side in ct.SIDES:
        named = ft.prefixed(rates, f"{side}_", ["season", "week"])
        contests = contests.join(named, ["season", "week", f"{side}_abbr"], "left")
    diff = F.col("away_win_perc") - F.col("home_win_perc")
    return rounded(contests.withColumn("win_perc_diff", diff))


@query
def facts(spark, root):
    """Entity facts with own and opponent box-score stats."""
    d = Domain(spark, root)
    return ct.team_games(d.games(), d.boxscores(), AS_OF)


@query
def placeholders(spark, root):
    """Box scores attached where usable; others null."""
    d = Domain(spark, root)
    joined = ct.attach_boxscores(d.games(), d.boxscores(), AS_OF)
    return joined.select(
        "boxscore_id", "season", "week", "away_score", "home_score",
        "away_total_yards", "home_total_yards", "away_time_of_possession",
        F.col("away_first_downs").isNull().alias("is_placeholder"),
    )


@query
def possession_seconds(spark, root):
    """Clock text to seconds; some clocks have no colon, some no number before it."""
    boxes, away = Domain(spark, root).boxscores(), F.col("away_time_of_possession")
    digit = F.substring("boxscore_id", 8, 1)
    spoiled = F.when(digit == "3", F.translate(away, ":", "")).when(digit == "5", F.concat(F.lit("x"), away))
    clock = F.coalesce(spoiled, away).alias("away_clock")
    return boxes.select("boxscore_id", clock, "home_time_of_possession").select(
        "boxscore_id",
        "away_clock",
        sc.clock_seconds(F.col("away_clock")).alias("away_seconds"),
        sc.clock_seconds(F.col("home_time_of_possession")).alias("home_seconds"),
    )


# --- form --------------------------------------------------------------------
@query
def ratio_sums(spark, root):
    return fm.ratio_sums(facts(spark, root), ENTITY_SEASON)


@query
def guarded_rates(spark, root):
    rates = fm.with_rates(fm.ratio_sums(facts(spark, root), ENTITY_SEASON))
    return rounded(rates.select(*ENTITY_SEASON, *fm.RATES))


@query
def stat_means(spark, root):
    return rounded(fm.stat_means(facts(spark, root), ENTITY_SEASON))


@query
def expanding_form(spark, root):
    """Form from the season's own earlier weeks."""
    form = build(spark, root).raw_form
    return rounded(form.where(~F.col("from_prior")).drop("from_prior", "starting"))


@query
def prior_season_fallback(spark, root):
    """Form carried over from the prior season."""
    form = build(spark, root).raw_form
    return rounded(form.where(F.col("from_prior")).drop("from_prior"))


@query
def refreshed_form(spark, root):
    """Form that was stored before some steps were known or right, and refreshed when they were.

    Two steps of one season are missing at first, those of another have other points; entities that
    only play there are listed late. Only the partitions that this reaches are computed again.
    """
    b, folder = build(spark, root), _fresh(spark, "form")
    facts, schedule = written(b.coded_facts, "coded-facts"), written(b.coded_schedule, "coded-schedule")
    missing = (F.col("season") == 1998) & F.col("week").isin(4, 9)
    wrong = (F.col("season") == 2000) & (F.col("week") == 12)
    first = facts.where(~missing).withColumn(
        "points_scored", F.when(wrong, F.col("points_scored") + 7).otherwise(F.col("points_scored"))
    )
    kept = KeptForm(folder, SPAN)
    kept.refresh(first, schedule.where(~missing))
    kept.refresh(facts, schedule, {(1998, 4), (1998, 9), (2000, 12)})
    return rounded(kept.form(spark).drop("starting"))


@query
def missing_entities(spark, root):
    """Scheduled entities without earlier facts in the season."""
    played = ct.drop_other_seasons(Domain(spark, root).games()).where("away_score IS NOT NULL")
    seen = ct.entity_rows(played, with_stats=False)
    return fm.entities_without_history(seen, Domain(spark, root).games(), SPAN)


@query
def league_mean(spark, root):
    return rounded(fm.league_means(build(spark, root).raw_form))


@query
def shrunk_form(spark, root):
    b = build(spark, root)
    return rounded(fm.entity_form(b.coded_facts, b.coded_schedule, SPAN))


@query
def contest_features(spark, root):
    """Flagship: every contest with both sides' pre-contest form and differences."""
    return rounded(build(spark, root).features)


@query
def colocated_features(spark, root):
    """Features and rankings of every contest from facts, form and rankings stored in buckets.

    Each is shuffled once, as it is stored; after that only contests move.
    """
    b, folder = build(spark, root), _fresh(spark, "colocated")
    schedule, facts = written(b.coded_schedule, "coded-schedule"), b.coded_facts
    entity, side = ["season", "week", "team_abbr"], ["season", "week", "away_name", "away_abbr"]
    form = co.store_colocated(fm.entity_form(facts, schedule, SPAN), f"{folder}/form", entity)
    kept = co.store_colocated(ft.results_of(facts), f"{folder}/results", side)
    ranks = co.store_colocated(b.rankings, f"{folder}/rankings", ["season", "week", "abbr"])
    contests = ft.stat_differences(ft.join_form(ft.covered(schedule, SPAN).join(kept.hint("merge"), side, "left"), form))
    return rounded(cb.join_rankings(contests, ranks))


# --- calendar ------------------------------------------------------------------
@query
def season_start(spark, root):
    """Season start and anchor of every year with orders."""
    year = F.year("o_orderdate").alias("year")
    per_year = Domain(spark, root).table("orders").groupBy(year).agg(F.count("*").alias("orders"))
    return per_year.select(
        "year", "orders",
        cal.season_start(F.col("year")).alias("season_start"),
        cal.season_anchor(F.col("year")).alias("week_one"),
    )


@query
def week_of_date(spark, root):
    """Week of every ship date."""
    day = F.col("l_shipdate").cast("date").alias("day")
    per_day = Domain(spark, root).table("lineitem").groupBy(day).agg(F.count("*").alias("items"))
    return per_day.select("day", "items", cal.week_of(F.col("day")).alias("week"))


@query
def season_of_date(spark, root):
    """Items and date range per season of the ship date."""
    day = F.col("l_shipdate").cast("date")
    items = Domain(spark, root).table("lineitem").select(day.alias("day"))
    return items.groupBy(cal.season_of(F.col("day")).alias("season")).agg(
        F.count("*").alias("items"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


@query
def calendar(spark, root):
    """Weeks and start dates of every season with orders or events."""
    d = Domain(spark, root)
    orders = d.table("orders").select(F.year("o_orderdate").alias("season"))
    events = d.table("events").select(F.year("ts").alias("season"))
    seasons = orders.unionByName(events).distinct()
    following = seasons.select(F.explode(F.array(F.col("season") - 1, F.col("season"))).alias("season"))
    return cal.step_calendar(following.distinct(), CALENDAR_AS_OF)


@query
def season_membership(spark, root):
    """Contest ids, some short or unreadable, against the season they are filed under."""
    orders = Domain(spark, root).table("orders")
    key = F.col("o_orderkey")
    full = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("x"), key.cast("string"))
    contest = (
        F.when(key % 11 == 0, F.substring(full, 1, 6))
        .when(key % 13 == 0, F.concat(F.lit("19x5"), F.substring(full, 5, 20)))
        .otherwise(full)
    )
    season = F.year("o_orderdate") - (key % 3 == 0).cast("int") + (key % 17 == 0).cast("int")
    filed = orders.select("o_orderkey", contest.alias("contest_id"), season.alias("season"))
    return filed.select(
        "*",
        cal.id_date(F.col("contest_id")).alias("id_date"),
        cal.in_other_season(F.col("contest_id"), F.col("season")).alias("other_season"),
    )


# --- lines -----------------------------------------------------------------------
@query
def line_validity(spark, root):
    """Counts of rejected, defaulted and computed lines."""
    return ln.line_quality(Domain(spark, root).quotes())


@query
def line_choice(spark, root):
    chosen = ln.with_choices(ln.valid_lines(Domain(spark, root).quotes()))
    return chosen.select(
        "o_orderkey", "home_spread", "away_spread", "spread_source", "total_line", "total_line_source"
    )


@query
def moneyline_source(spark, root):
    chosen = ln.with_choices(ln.valid_lines(Domain(spark, root).quotes()))
    return chosen.select("o_orderkey", "spread_source", "total_line_source", "moneyline_source")


@query
def moneyline(spark, root):
    priced = ln.with_moneylines(ln.with_choices(ln.valid_lines(Domain(spark, root).quotes())))
    return priced.select("o_orderkey", "moneyline_source", "home_moneyline", "away_moneyline")


@query
def observed_line_quality(spark, root):
    """The counts of ``line_validity``, taken while the final lines are written."""
    d = Domain(spark, root)
    inputs = Inputs(None, None, None, None, d.quotes(), None, d.code_lookup())
    return Build(inputs, SPAN, AS_OF.year, CURRENT_WEEK).counted_lines[1]


@query
def lines_from_csv(spark, root):
    """Quotes stored as plain CSV, read by their declared types, and the final lines of them."""
    d, path = Domain(spark, root), _fresh(spark, "quotes")
    quotes = d.quotes()
    store.write_csv(quotes, path)
    return ln.season_lines(store.read_lines(spark, path, quotes.schema), d.code_lookup())


@query
def season_lines(spark, root):
    d = Domain(spark, root)
    return ln.season_lines(d.quotes(), d.code_lookup())


@query
def lines_of_season(spark, root):
    """Lines of one season: all other seasons are filtered out."""
    d = Domain(spark, root)
    return ln.season_lines(d.quotes(), d.code_lookup(), season=AS_OF.year - 1)


# --- codes, ratings, rankings ------------------------------------------------------
@query
def standard_codes(spark, root):
    """Codes in many spellings under the three miss rules."""
    orders = Domain(spark, root).table("orders")
    code = pick(CODE_POOL, F.col("o_orderkey") % len(CODE_POOL))
    padded = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit(" "), code, F.lit(" "))).otherwise(code)
    raw = F.when(F.col("o_custkey") % 23 != 0, padded)
    return orders.select("o_orderkey", raw.alias("code")).select(
        "*",
        sc.standard_code(F.col("code")).alias("exact_or_kept"),
        sc.any_standard_code(F.col("code")).alias("any_or_kept"),
        sc.rating_code(F.col("code")).alias("known_or_null"),
    )


@query
def rating_pairs(spark, root):
    """In-season ratings in both orientations, oldest first."""
    return rt.by_date(rt.season_ratings(Domain(spark, root).ratings(), SPAN))


@query
def metric_pivot(spark, root):
    """All metrics of an entity and step in one row."""
    return rk.pivot_metrics(rk.ranking_values(Domain(spark, root).rankings_raw()))


@query
def metric_full_join(spark, root):
    """The same by full outer joins."""
    values = written(rk.ranking_values(Domain(spark, root).rankings_raw()), "ranking-values")
    return rk.join_metrics(values, rk.RANKED)


@query
def carry_forward(spark, root):
    """Current week's entries copied to the later weeks of the current season."""
    wide = rk.pivot_metrics(rk.ranking_values(Domain(spark, root).rankings_raw()))
    return rk.carry_forward(wide, SPAN, AS_OF.year, CURRENT_WEEK)


@query
def last_known(spark, root):
    """Gaps filled with the entity's last known value of the season."""
    wide = rk.pivot_metrics(rk.ranking_values(Domain(spark, root).rankings_raw()))
    return rk.last_known(wide, ["season", "abbr"], "week", rk.RANKED)


@query
def html_items(spark, root):
    """Items of the first list of every page."""
    return rk.html_items(Domain(spark, root).table("pages").select("page_id", "html"))


@query
def nested_items(spark, root):
    """Items of a list that holds every page's first list in one of its items, behind a comment."""
    pages = Domain(spark, root).table("pages")
    inner = F.regexp_extract("html", r"(?is)<ul\b[^>]*>.*?</ul\s*>", 0)
    opening = F.lit("</ul><!-- <ul><li>no</li></ul> --><UL class='outer'><li>0.5</li><LI>all: ")
    html = F.concat(opening, inner, F.lit("<!-- </ul> --></LI><li>last</li></UL ><ul><li>no</li></ul>"))
    return rk.html_items(pages.select("page_id", html.alias("html")))


@query
def rankings(spark, root):
    return build(spark, root).rankings


# --- combination ---------------------------------------------------------------------
@query
def division_games(spark, root):
    """Same-group flag of every contest."""
    d = Domain(spark, root)
    coded = ct.standardise_sides(d.games()).select("season", "week", "away_abbr", "home_abbr")
    return lk.same_group(coded, d.divisions())


@query
def combined(spark, root):
    return rounded(build(spark, root).combined)


@query
def all_data(spark, root):
    """The final table, newest first."""
    return rounded(build(spark, root).all_data)


@query
def feature_table(spark, root):
    """The final table's size per season, from the whole build."""
    table = build(spark, root).feature_table
    return table.groupBy("season").agg(
        F.count("*").alias("contests"),
        F.count("result").alias("with_result"),
        F.sum("division").alias("division_games"),
        F.expr("rint(avg(points_scored_diff) * 1e6D) / 1e6D").alias("mean_points_diff"),
        F.lit(len(table.columns)).alias("columns"),
    )


@query
def footer_counts(spark, root):
    """Values of every column of a stored table with gaps, without reading a row of it."""
    path, key = _fresh(spark, "holed"), F.col("l_orderkey")
    items = Domain(spark, root).table("lineitem")
    holed = items.select(
        "l_orderkey",
        F.when(key % 3 > 0, F.col("l_quantity")).alias("quantity"),
        F.when(key % 7 == 0, F.col("l_returnflag")).alias("flag"),
        F.when(key < 0, F.col("l_tax")).alias("tax"),
    )
    holed.write.parquet(path)
    counts = cb.counts_in_footers(spark, path)
    left = cb.drop_all_null(spark.read.parquet(path), path).columns
    rows = [(name, counts[name], name in left) for name in holed.columns]
    return spark.createDataFrame(rows, "column string, n_values long, kept boolean")


@query
def completed(spark, root):
    return rounded(build(spark, root).completed)


@query
def to_predict(spark, root):
    return rounded(build(spark, root).to_predict)


@query
def outputs(spark, root):
    both = build(spark, root).outputs()
    return both.groupBy("output", "season", "week").agg(F.count("*").alias("contests"))


# --- nested data -----------------------------------------------------------------------
@query
def nested_flatten(spark, root):
    """(path, leaf) rows of a nested map."""
    events = Domain(spark, root).table("events")
    props = F.from_json("props", "map<string,int>")
    nested = events.select("event_id", F.create_map("event_type", props).alias("record"))
    flat = rs.flatten_map(nested, "record", ["event_id"])
    return flat.select("event_id", F.array_join("path", "/").alias("path"), "leaf")


@query
def variant_flatten(spark, root):
    """(path, leaf) rows of JSON documents that are nested to depths of their own."""
    events = Domain(spark, root).table("events")
    text, depth = F.col("props"), F.col("event_id") % 4
    for level in range(1, 4):
        deeper = F.concat(F.lit(f'{{"level{level}": ['), text, F.lit(', 7], "none": null, "empty": {}, "by": "'), "event_type", F.lit('"}'))
        text = F.when(depth >= level, deeper).otherwise(text)
    flat = rs.flatten_variant(events.select("event_id", F.parse_json(text).alias("record")), "record", ["event_id"])
    return flat.select("event_id", F.array_join("path", "/").alias("path"), F.col("leaf").cast("string").alias("leaf"))


@query
def nested_table(spark, root):
    """Innermost keys as columns, outer path as row key."""
    events = Domain(spark, root).table("events")
    k = F.from_json("props", "map<string,int>")["k"].cast("double")
    record = F.create_map(F.lit("k"), k, F.lit("value"), F.col("value"))
    nested = events.select("event_id", F.create_map("event_type", record).alias("record"))
    wide = rs.nested_table(nested, "record", ["event_id"], ["k", "value"])
    return wide.withColumn("path", F.array_join("path", "/"))


@query
def prediction_lines(spark, root):
    """Padded text lines of win chances."""
    games = Domain(spark, root).games()
    chance = F.pmod(F.col("season") * 7 + F.col("week") * 31 + F.length("away_abbr") * 13, F.lit(1000)) / 1000
    return games.select(
        "boxscore_id",
        sc.prediction_line(
            F.col("season"), F.col("week"), F.col("away_name"), F.col("home_name"), chance
        ).alias("line"),
    )


# --- learning ------------------------------------------------------------------------------
@query
def normality(spark, root):
    """Omnibus normality test of numeric features."""
    tested = scaling.normality(Domain(spark, root).table("lineitem"), LINE_ITEM_FEATURES)
    return tested.select(
        "feature", "n",
        F.round("skew", 6).alias("skew"),
        F.round("excess", 6).alias("excess"),
        F.round("k2", 2).alias("k2"),
        F.round("p_value", 6).alias("p_value"),
        "is_normal",
    )


@query
def zscore(spark, root):
    """Population z-scores of numeric features."""
    items = Domain(spark, root).table("lineitem")
    features = LINE_ITEM_FEATURES
    moments = items.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in features],
        *[F.stddev_pop(c).alias(f"{c}_sigma") for c in features],
    ).first()
    scaled = {
        f"{c}_z": scaling.standardised(F.col(c), moments[f"{c}_mean"], moments[f"{c}_sigma"])
        for c in features
    }
    return rounded(items.select("l_orderkey", "l_linenumber", "l_partkey", *features).withColumns(scaled))


@query
def yeo_johnson(spark, root):
    """Power transform at fixed lambdas, on both signs."""
    x = F.col("c_acctbal") / 777
    return rounded(
        Domain(spark, root).table("customer").select(
            "c_custkey",
            *[
                dist.yeo_johnson(x, F.lit(lam)).alias(name)
                for name, lam in (("half", 0.5), ("log_up", 0.0), ("log_down", 2.0), ("third", -1.5))
            ],
        )
    )


@query
def yeo_johnson_fitted(spark, root):
    """Maximum-likelihood lambdas of skewed features."""
    orders = Domain(spark, root).table("orders")
    chance = (F.col("o_orderkey") * 7919 % 99991 + 0.5) / 99991
    prices = orders.select(
        (F.col("o_totalprice") / 1000).alias("price"),
        F.log1p(F.col("o_totalprice")).alias("log_price"),
        (F.col("o_custkey") % 97 - 40).cast("double").alias("signed"),
        (F.lit(1500.0) - F.log(chance) * 40).alias("far"),
        (F.log(chance) * 40 - 1500.0).alias("far_below"),
    )
    return rounded(scaling.yeo_johnson_lambdas(prices, prices.columns).select("feature", "lam"), 3)


@query
def holdout_split(spark, root):
    orders = Domain(spark, root).table("orders")
    return orders.select("o_orderkey", sampling.in_holdout(F.col("o_orderkey")).alias("held_out"))


def order_scores(spark, root):
    score = (F.floor("o_totalprice") % 60).cast("int")
    return Domain(spark, root).table("orders").select(
        "o_orderkey", score.alias("score"), (F.col("o_custkey") % 37 + 10).cast("double").alias("guess")
    )


@query
def folds(spark, root):
    """Stratified folds by target value."""
    return sampling.stratified_folds(order_scores(spark, root), "score", "o_orderkey")


@query
def holdout_error(spark, root):
    """Errors of a fixed predictor on the holdout rows."""
    held = order_scores(spark, root).where(sampling.in_holdout(F.col("o_orderkey")))
    return rounded(ml.error_summary(held, "score", "guess"))


@query
def scaled_features(spark, root):
    """Mean and deviation of every numeric feature of the final table, scaled.

    Three more features are narrow, constant and skewed far from zero.
    """
    table, key = build(spark, root).completed, ml.contest_key()
    chance = (F.pmod(key, F.lit(99_991)) + 0.5) / 99_991
    more = {"narrow": chance * 1e-14, "constant": F.lit(1523.7), "far": F.lit(1500.0) - F.log(chance) * 40}
    table = written(table.withColumns(more), "to-scale")
    features = [*ml.split_features(table)]
    params = written(scaling.fit_scaling(table, features), "scaling")
    scaled = scaling.unpivoted(scaling.apply_scaling(table, params, features), features)
    shown = scaled.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
    kinds = params.select("feature", (F.col("kind") == "constant").alias("constant"))
    # abs: a mean of -0.0 is one of 0.0
    return rounded(shown.join(kinds, "feature").withColumn("mean", F.abs("mean")), 5)


@query
def search_settings(spark, root):
    """The settings the full search draws, one row per order of the first hundred draws, all in the space."""
    draws = ml.draw_settings(ml.SEARCH_SPACE, ml.DRAWS, sampling.SEED)
    inside = all(d[k] in list(v) for d in draws for k, v in ml.SEARCH_SPACE.items())
    orders = Domain(spark, root).table("orders")
    draw = (F.col("o_orderkey") % len(draws)).cast("int").alias("draw")
    return orders.groupBy(draw).agg(F.count("*").alias("orders")).select(
        "draw", "orders", F.lit(inside).alias("inside"), F.lit(len(ml.SEARCH_SPACE)).alias("settings")
    )


#: Fewer and shallower rounds than the search's own, which are `model.SEARCH_SPACE`; all else is whole.
SMALL_SPACE = {
    **ml.SEARCH_SPACE,
    "maxIter": [2, 3],
    "stepSize": [0.1, 0.2],
    "maxDepth": [2, 3],
}
SMALL_DRAWS = 2


def _trained(spark, root):
    b = build(spark, root)
    return b, *ml.train_and_score(b.completed, b.to_predict, space=SMALL_SPACE, draws=SMALL_DRAWS)


@query
def score_predictions(spark, root):
    """Upcoming contests, with checks of their predicted scores."""
    b, scored, _ = _trained(spark, root)
    low, high = b.completed.agg(F.min(F.least(*ml.TARGETS)), F.max(F.greatest(*ml.TARGETS))).first()
    shown = {}
    for side in ("away", "home"):
        p = F.col(f"predicted_{side}_score")
        shown[f"{side}_in_range"] = p.between(low, high)
        shown[f"{side}_rounded"] = F.abs(p * 10 - F.rint(p * 10)) < 1e-6
    return scored.withColumns(shown).select("season", "week", "away_abbr", "home_abbr", *shown)


@query
def train_and_score(spark, root):
    """Held-out contests per target, their spread, and whether the errors are sane beside it.

    The contests' scores are made up, so there is little to learn; ``kept_model`` has a target with
    something to learn, and requires that it is learned.
    """
    b, _, errors = _trained(spark, root)
    held = sampling.in_holdout(ml.contest_key())
    spread = b.completed.where(held).select(*ml.TARGETS).unpivot([], list(ml.TARGETS), "of", "score")
    spread = spread.groupBy("of").agg(F.stddev_pop(F.col("score").cast("int")).alias("deviation"))
    found = errors.join(spread, F.col("target") == F.col("of"))
    sane = (F.col("rmse") < F.col("deviation") * 1.25).alias("sane")
    return rounded(found.select("target", "n", "deviation", sane, (F.col("mae") <= F.col("rmse")).alias("ordered")))


ORDER_FEATURES = ["items", "quantity", "discount", "gappy", "same"]


def order_targets(spark, root):
    """Orders with features and a target that follows from them: whole thousands of the items' prices."""
    d = Domain(spark, root)
    items = d.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").cast("double").alias("items"),
        F.sum("l_quantity").alias("quantity"),
        F.max("l_discount").alias("discount"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
    )
    gappy = F.when(F.col("o_orderkey") % 5 > 0, F.col("quantity") / F.col("items"))
    made = {"gappy": gappy, "same": F.lit(7.0), "thousands": F.floor(F.col("cents") / 100_000).cast("int")}
    return items.withColumns(made).drop("cents")


@query
def kept_model(spark, root):
    """A model that is trained, stored, loaded by a second job and applied there to all orders.

    Draws of the real search space, but for the rounds, are tried on two folds of the orders not held
    out and kept in a ledger. The loaded model must give every order what the trained one does, and
    have an error on the held-out orders below nine tenths of their deviation, which is the mean's error.
    """
    folder = _fresh(spark, "kept")
    orders = written(order_targets(spark, root), "order-targets")
    space = {**ml.SEARCH_SPACE, "maxIter": [8, 10], "stepSize": [0.1, 0.2], "maxDepth": [4, 5]}
    trained = ml.train(
        orders, ORDER_FEATURES, space, draws=2, folds=2, targets=["thousands"], key=F.col("o_orderkey"), ledger=f"{folder}/ledger"
    )
    version = store.add_version(spark, f"{folder}/model", trained.model.save)
    loaded = PipelineModel.load(version)
    before = kept.scored(trained.model, orders).select("o_orderkey", F.col("predicted_thousands").alias("first"))
    after = kept.scored(loaded, orders).withColumn("held", sampling.in_holdout(F.col("o_orderkey")))
    both = after.join(before, "o_orderkey")
    trials = spark.read.parquet(f"{folder}/ledger").agg(F.countDistinct("setting", "fold", "iterations")).first()[0]
    settings = len({search.named(s) for s in ml.draw_settings(space, 2, sampling.SEED)})
    off = F.col("thousands") - F.col("predicted_thousands")
    shown = both.agg(
        F.count("*").alias("orders"),
        F.count_if("held").alias("held_out"),
        F.stddev_pop(F.when(F.col("held"), F.col("thousands"))).alias("deviation"),
        F.sqrt(F.avg(F.when(F.col("held"), off * off))).alias("rmse"),
        F.count_if(~F.col("first").eqNullSafe(F.col("predicted_thousands"))).alias("changed_by_reload"),
    )
    learned = (F.col("rmse") < F.col("deviation") * 0.9).alias("learned")
    recorded = F.lit(trials == 2 * settings).alias("trials_recorded")
    return rounded(shown.select("orders", "held_out", "deviation", learned, "changed_by_reload", recorded))


# --- stored tables ------------------------------------------------------------------------------
def _fresh(spark, label: str) -> str:
    return f"{shared_folder(spark)}/stored/{label}-{uuid.uuid4().hex}"


@query
def stored_version(spark, root):
    """A stage stored, built again by force from its own version, and read back."""
    path = _fresh(spark, "events")
    events = Domain(spark, root).table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = store.materialize(spark, path, lambda: events)
    return store.materialize(spark, path, lambda: first.withColumn("value", F.col("value") * 2), force=True)


@query
def stored_partitions(spark, root):
    """Steps stored, one of them emptied, one added, and the due ones refreshed."""
    path = _fresh(spark, "steps")
    orders = Domain(spark, root).table("orders").select(
        F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), "o_orderkey"
    )
    due = (F.col("season") == 1997) & (F.col("week") <= 6)
    store.refresh_partitions(orders.where("NOT (season = 1996 AND week = 2)").withColumn("pass", F.lit(1)), path, F.lit(True))
    newer = orders.where("NOT (season = 1997 AND week = 3)").withColumn("pass", F.lit(2))
    fresh = store.rows_to_refresh(newer, spark.read.parquet(path), due)
    store.refresh_partitions(fresh, path, F.lit(True), due)
    return spark.read.parquet(path).groupBy("season", "week", "pass").agg(F.count("*").alias("orders"))


@query
def csv_round_trip(spark, root):
    """Customers written as CSV and read back, as the first path that exists."""
    path, customers = _fresh(spark, "customers"), Domain(spark, root).table("customer")
    store.write_csv(customers, path)
    return store.read_first_csv(spark, [None, f"{path}-missing", path], customers.schema)


@query
def csv_declared(spark, root):
    """Suppliers written as CSV with an index column and read by their declared types without it."""
    path, suppliers = _fresh(spark, "suppliers"), Domain(spark, root).table("supplier")
    store.write_csv(suppliers.select(F.col("s_suppkey").alias("_row"), "*"), path)
    return store.read_csv(spark, path, suppliers.schema)


@query
def csv_unnamed(spark, root):
    """Customers from the first CSV file of a list that is there, less the index column it came with."""
    path, customers = _fresh(spark, "customers"), Domain(spark, root).table("customer")
    indexed = customers.select(F.monotonically_increasing_id().alias("Unnamed: 0"), "*")
    store.write_csv(indexed, path)
    return store.read_first_csv(spark, [None, f"{path}-missing", path], customers.schema)


@query
def record_lists(spark, root):
    """Items from one JSON list of records per order; a field that a record lacks is null."""
    items = Domain(spark, root).table("lineitem")
    quantity = F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity")).alias("quantity")
    record = F.struct(F.col("l_linenumber").alias("line"), quantity, F.col("l_returnflag").alias("flag"))
    lists = items.groupBy("l_orderkey").agg(F.to_json(F.collect_list(record)).alias("records"))
    return store.records_in(lists, "records", "line int, quantity double, flag string, absent string")


@query
def stamped_dates(spark, root):
    """Dates of orders as text, some unreadable or missing, as timestamps or null."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    spoiled = (
        F.when(key % 11 == 0, F.lit("unknown")).when(key % 13 == 0, F.concat(F.substring(day, 1, 5), F.lit("13-45")))
        .when(key % 17 == 0, F.lit("")).when(key % 19 != 0, day)
    )
    return cb.stamp_dates(Domain(spark, root).table("orders").select("o_orderkey", spoiled.alias("date")))


@query
def missing_values(spark, root):
    """Account balances with some NaN, which count as missing from reading on."""
    customers = Domain(spark, root).table("customer")
    holed = F.when(F.col("c_custkey") % 7 == 0, float("nan")).otherwise(F.col("c_acctbal"))
    return store.no_nan(customers.select("c_custkey", holed.alias("balance")))
