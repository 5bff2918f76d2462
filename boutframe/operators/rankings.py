"""Rankings: raw page items and text entries to one wide row per entity and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutframe import fixed_values as fv
from boutframe.functions import scalars as sc
from boutframe.functions.calendar import SeasonSpan

RANKED = [*fv.RANKING_RATINGS, *fv.RANKING_STATS]


def balanced(html: Column, tag: str) -> Column:
    """Contents of all elements of one kind, in the order in which they begin, as an array.

    An element ends at the closing tag of its own depth, so one inside another does not end it. Tag
    names count in any case. Comments and stray closing tags are skipped, and an element that is
    never closed is left out. Null for null.
    """
    # The text in pieces, each from one tag of the kind up to the next; the first has no tag.
    edge = rf"(?i)(?=<{tag}(?=[\s/>]))|(?=</{tag}\s*>)"
    pieces = F.split(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), edge)
    opens = F.transform(pieces, lambda p: F.when(p.rlike(rf"(?i)^<{tag}(?=[\s/>])"), 1).when(p.rlike(rf"(?i)^</{tag}\s*>"), -1).otherwise(0))
    start = F.struct(
        F.lit(0).alias("nth"),
        F.array().cast("array<int>").alias("open"),  # pieces that began the elements still open
        F.array().cast("array<struct<first:int,last:int>>").alias("done"),
    )

    def step(state: Column, sign: Column) -> Column:
        nth, depth = state["nth"], F.size(state["open"])
        closes = (sign == -1) & (depth > 0)
        inner = F.struct(F.element_at(state["open"], -1).alias("first"), nth.alias("last"))
        return F.struct(
            (nth + 1).alias("nth"),
            F.when(sign == 1, F.concat(state["open"], F.array(nth)))
            .when(closes, F.slice(state["open"], F.lit(1), depth - 1)).otherwise(state["open"]).alias("open"),
            F.when(closes, F.concat(state["done"], F.array(inner))).otherwise(state["done"]).alias("done"),
        )

    spans = F.array_sort(F.aggregate(opens, start, step)["done"])
    text = lambda s: F.array_join(F.slice(pieces, s["first"] + 1, s["last"] - s["first"]), "")
    return F.transform(spans, lambda s: F.regexp_replace(text(s), rf"(?is)^<{tag}\b[^>]*>", ""))


def html_items(
    pages: DataFrame, html: str = "html", container: str = "ul", item: str = "li"
) -> DataFrame:
    """Items of the first container on each page: position, text label, numeric value.

    Containers and items may hold others of their kind: the first container ends with its own
    closing tag, an item inside an item is a row of its own after it, and its text is part of the
    outer label. Tag names count in any case and comments are skipped. Pages without a container
    that is closed give no rows. The whole page text is searched.
    """
    others = [c for c in pages.columns if c != html]
    first = pages.select(*others, F.get(balanced(F.col(html), container), F.lit(0)).alias("_first"))
    exploded = first.select(*others, F.posexplode(balanced(F.col("_first"), item)).alias("pos", "item"))
    label = F.trim(F.regexp_replace("item", r"<[^>]*>", ""))
    return exploded.select(
        *others, "pos", label.alias("label"), sc.number_or_zero(label).alias("value")
    )


def entity_of(metric: Column, label: Column) -> Column:
    """Place name to code; rating labels also carry a win-loss record to strip."""
    plain = F.when(metric.isin(fv.RANKING_RATINGS), sc.strip_record(label)).otherwise(label)
    return sc.place_code(plain)


def ranking_values(raw: DataFrame) -> DataFrame:
    """Long (season, week, abbr, metric, value) with unreadable numbers as 0.0."""
    return raw.select(
        "season", "week",
        entity_of(F.col("metric"), F.col("label")).alias("abbr"),
        "metric",
        sc.number_or_zero(F.col("value")).alias("value"),
    )


def pivot_metrics(values: DataFrame, metrics: list[str] = RANKED) -> DataFrame:
    """One wide row per entity and step: a full outer join of all metrics in one shuffle.

    Metrics are unique per entity and step. The listed names fix the columns, so no
    extra pass over the data is needed, and partial aggregation runs before the shuffle.
    """
    return values.groupBy("season", "week", "abbr").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )


def join_metrics(values: DataFrame, metrics: list[str]) -> DataFrame:
    """The same as :func:`pivot_metrics` by successive full outer joins."""
    keys = ["season", "week", "abbr"]
    wide = None
    for m in metrics:
        one = values.where(F.col("metric") == m).select(*keys, F.col("value").alias(m))
        wide = one if wide is None else wide.join(one, keys, "full")
    return wide


def carry_forward(
    rankings: DataFrame, span: SeasonSpan, season: int, current_week: int
) -> DataFrame:
    """Copy the current week's rows of ``season`` to each later week; others stay."""
    last = span.weeks_of(F.col("season"))
    current = (F.col("season") == season) & (F.col("week") == current_week)
    later = (F.col("season") == season) & (F.col("week") > current_week)
    weeks = F.when(current & (last > current_week), F.sequence(F.lit(current_week), last))
    served = F.coalesce(weeks, F.array(F.col("week")))
    return rankings.where(~later).withColumn("week", F.explode(served))


def last_known(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Fill nulls with the last non-null value of the same group in order.

    For groups bounded by the calendar: one row per step of an entity's season.
    """
    so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})


def season_rankings(
    raw: DataFrame, span: SeasonSpan, season: int, current_week: int
) -> DataFrame:
    """Wide rankings of all seasons: pivoted, carried forward, gaps as 0.0."""
    wide = pivot_metrics(ranking_values(raw))
    return carry_forward(wide, span, season, current_week).na.fill(0.0, RANKED)
