"""Whole jobs over all seasons at once; the season is a column, not a loop."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from boutframe.functions.calendar import SeasonSpan
from boutframe.functions.scalars import standard_code
from boutframe.operators import combine as cb
from boutframe.operators import contests as ct
from boutframe.operators import features as ft
from boutframe.operators import form as fm
from boutframe.operators.kept_form import KeptForm, steps_of
from boutframe.operators.lines import season_lines
from boutframe.operators.rankings import season_rankings
from boutframe.operators.ratings import season_ratings
from boutframe.session import written, written_path, written_together
from boutframe.sources import store


@dataclass
class Inputs:
    """The tables a full build reads."""

    games: DataFrame
    boxscores: DataFrame
    ratings: DataFrame
    rankings_raw: DataFrame
    lines: DataFrame
    divisions: DataFrame
    codes: DataFrame | None = None


@dataclass
class Build:
    """The stages of a full build, each computed on first use.

    Stages that several later stages read are written once, so their plans are not
    repeated; everything else stays lazy.
    """

    inputs: Inputs
    span: SeasonSpan
    current_season: int
    current_week: int
    facts_path: str | None = None
    rebuild_facts: bool = False
    form_path: str | None = None

    def __post_init__(self):
        #: Steps whose kept facts were replaced; None if all were computed.
        self.changed_steps: set[tuple[int, int]] | None = None

    @property
    def as_of(self) -> date:
        return self.span.as_of

    @cached_property
    def written_stages(self) -> dict[str, DataFrame]:
        """Schedule and, unless kept elsewhere, facts: both read the games alone."""
        stages = {"schedule": ct.numbered_schedule(self.inputs.games)}
        if self.facts_path is None:
            stages["facts"] = self.computed_facts()
        return written_together(stages)

    def computed_facts(self) -> DataFrame:
        return ct.team_games(self.inputs.games, self.inputs.boxscores, self.as_of)

    @cached_property
    def facts(self) -> DataFrame:
        """Entity facts; kept between runs at ``facts_path``, where one is given.

        Of a kept table only missing partitions and those around the current week are
        computed again.
        """
        if self.facts_path is None:
            return self.written_stages["facts"]
        facts = self.computed_facts()
        spark = facts.sparkSession
        kept = None if self.rebuild_facts else store.read_if_present(spark, self.facts_path)
        due = F.lit(True)
        if kept is not None:
            due = store.due_for_refresh(self.as_of)
            facts = store.rows_to_refresh(facts, kept, due)
            # Steps that had rows count too: a step that is emptied has changed.
            self.changed_steps = steps_of(kept.where(due))
        replaced = store.refresh_partitions(facts, self.facts_path, F.lit(True), due)
        if kept is not None:
            self.changed_steps |= replaced
        return spark.read.parquet(self.facts_path)

    @cached_property
    def schedule(self) -> DataFrame:
        return self.written_stages["schedule"]

    @cached_property
    def coded_facts(self) -> DataFrame:
        return self.facts.withColumn("team_abbr", standard_code(F.col("team_abbr")))

    @cached_property
    def coded_schedule(self) -> DataFrame:
        return ct.standardise_sides(self.schedule)

    @cached_property
    def raw_form(self) -> DataFrame:
        return fm.raw_form(self.coded_facts, self.coded_schedule, self.span)

    @cached_property
    def features(self) -> DataFrame:
        """Features of all contests; kept between runs at ``form_path``, where one is given.

        Of kept features only those that changed facts reach are computed again.
        """
        if self.form_path is None:
            return ft.contest_features(self.schedule, self.facts, self.span)
        facts, kept = self.coded_facts, KeptForm(self.form_path, self.span)  # facts first: they tell the steps
        changed = self.changed_steps
        if changed is not None:
            # A season may have begun with contests listed and none played.
            near = range(self.current_week - 1, self.current_week + 2)
            changed = changed | {(self.current_season, week) for week in near}
        kept.refresh(facts, self.coded_schedule, changed)
        return kept.features(facts.sparkSession)

    @cached_property
    def rankings(self) -> DataFrame:
        return season_rankings(
            self.inputs.rankings_raw, self.span, self.current_season, self.current_week
        )

    @cached_property
    def ratings(self) -> DataFrame:
        return season_ratings(self.inputs.ratings, self.span)

    @cached_property
    def lines(self) -> DataFrame:
        return season_lines(self.inputs.lines, self.inputs.codes)

    @cached_property
    def counted_lines(self) -> tuple[DataFrame, DataFrame]:
        """The lines, written, and one row of counts that were taken in the same pass."""
        counts = Observation("line_quality")
        lines = written(season_lines(self.inputs.lines, self.inputs.codes, quality=counts), "lines")
        found = counts.get
        schema = ", ".join(f"{name} long" for name in found)
        return lines, lines.sparkSession.createDataFrame([tuple(found.values())], schema)

    @cached_property
    def combined(self) -> DataFrame:
        features = self.features if self.form_path else written(self.features, "features")
        return cb.combine(
            features, self.rankings, self.ratings, self.lines, self.inputs.divisions
        )

    @cached_property
    def feature_table(self) -> DataFrame:
        """The final table without all-null columns, unordered."""
        combined = self.combined
        path = written_path(combined, "combined")
        stored = combined.sparkSession.read.schema(combined.schema).parquet(path)
        return cb.stamp_dates(cb.drop_all_null(stored, path))

    @cached_property
    def all_data(self) -> DataFrame:
        return cb.newest_first(self.feature_table)

    @cached_property
    def completed(self) -> DataFrame:
        return cb.completed(self.feature_table)

    @cached_property
    def to_predict(self) -> DataFrame:
        return cb.to_predict(self.feature_table, self.as_of)

    def outputs(self) -> DataFrame:
        """Both output tables in one, told apart by ``output``."""
        return self.completed.withColumn("output", F.lit("completed")).unionByName(
            self.to_predict.withColumn("output", F.lit("to_predict"))
        )
