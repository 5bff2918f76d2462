"""Form and contest features that are stored, and refreshed where facts have changed.

The stored state is what every entity did in every step: sums and counts, one small row each. A
change in one week of a season reaches the steps after it in that season and the steps of the next
season, which a last season may stand in for; only these are computed again, from the state of the
seasons around them, and only their partitions are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.functions.calendar import SeasonSpan
from boutframe.operators.features import features_of
from boutframe.operators.form import first_listings, running_form, shrink_first_games, steps_served, weekly_totals
from boutframe.session import written
from boutframe.sources import store

Steps = Collection[tuple[int, int]]


def within(starts: dict[int, int]) -> Column:
    """Steps of the given seasons from a week on."""
    season, week = F.col("season"), F.col("week")
    return reduce(or_, [(season == s) & (week >= w) for s, w in sorted(starts.items())], F.lit(False))


def exactly(steps: Steps) -> Column:
    """Steps of a list, as ranges of partitions."""
    weeks = defaultdict(list)
    for season, week in steps:
        weeks[season].append(week)
    season, week = F.col("season"), F.col("week")
    return reduce(or_, [(season == s) & week.isin(sorted(w)) for s, w in sorted(weeks.items())], F.lit(False))


def steps_of(df: DataFrame) -> set[tuple[int, int]]:
    """The steps that a table has rows in; the calendar bounds them."""
    return {tuple(r) for r in df.select("season", "week").distinct().collect()}


class KeptForm:
    """Stored totals, form and features under one folder.

    ``facts`` and ``schedule`` have standard entity codes; steps outside ``span`` have no part in it.
    """

    def __init__(self, folder: str, span: SeasonSpan):
        self.folder, self.span = folder, span

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _stored(self, spark, name: str) -> DataFrame | None:
        return store.read_if_present(spark, self._path(name))

    def form(self, spark) -> DataFrame:
        """Form of every entity before every step, before shrinkage."""
        return spark.read.parquet(self._path("form"))

    def features(self, spark) -> DataFrame:
        return spark.read.parquet(self._path("features"))

    def refresh(self, facts: DataFrame, schedule: DataFrame, changed: Steps | None = None) -> dict[str, Column]:
        """Bring the stored tables up to date with facts and schedules that changed in some steps.

        Without ``changed``, or where nothing is stored yet, all steps are computed. Returns which
        steps of ``form`` and ``features`` were replaced. An entity that enters or leaves a season's
        schedule changes when its last season stands in, so that season is computed from week 1.
        """
        spark = facts.sparkSession
        if changed is None or self._stored(spark, "totals") is None:
            changed = {(s, w) for s in range(self.span.first, self.span.last + 1) for w in range(1, 54)}
        if not changed:
            return {"form": F.lit(False), "features": F.lit(False)}
        due = exactly(changed)
        store.refresh_partitions(weekly_totals(facts.where(due), self.span), self._path("totals"), F.lit(True), due)

        seasons = sorted({s for s, _ in changed})
        starts = {s: min(w for t, w in changed if t == s) + 1 for s in seasons}
        starts |= dict.fromkeys(self._relisted(schedule, seasons), 1)
        later = {s + 1: 1 for s in seasons if s < self.span.last}
        served = within(starts | later)
        near = F.col("season").isin(sorted({t for s in starts | later for t in (s - 1, s, s + 1)}))
        totals, listings = (spark.read.parquet(self._path(n)).where(near) for n in ("totals", "listings"))
        form = steps_served(running_form(totals, listings), self.span).where(served)
        store.refresh_partitions(form, self._path("form"), F.lit(True), served)

        # Results stand at the changed steps themselves, form at those served.
        shown = served | due
        now = self.form(spark).where(shown)
        shrunk = shrink_first_games(now, self.span)
        features = features_of(schedule.where(shown), facts.where(shown), shrunk, self.span)
        store.refresh_partitions(features, self._path("features"), F.lit(True), shown)
        return {"form": served, "features": shown}

    def _relisted(self, schedule: DataFrame, seasons: list[int]) -> list[int]:
        """Seasons in which some entity's first scheduled week is not the stored one, which is replaced."""
        spark, of = schedule.sparkSession, F.col("season").isin(seasons)
        fresh = written(first_listings(schedule.where(of), self.span), "listings")
        stored = self._stored(spark, "listings")
        if stored is None:
            found = fresh
        else:
            known = stored.where(of).select(*fresh.columns)
            found = fresh.exceptAll(known).unionByName(known.exceptAll(fresh))
        relisted = [r["season"] for r in found.select("season").distinct().collect()]
        if relisted:
            rows = fresh.where(F.col("season").isin(relisted))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(
                self._path("listings")
            )
        return relisted
