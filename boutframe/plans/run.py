"""The jobs a user runs: build the contest tables, train models, score upcoming contests.

    spark-submit -m boutframe.plans.run build   <input folder> <output folder> <as-of date> <first season>
    spark-submit -m boutframe.plans.run train   <output folder>
    spark-submit -m boutframe.plans.run score   <output folder> <as-of date>
    spark-submit -m boutframe.plans.run predict <output folder> <as-of date>

``score`` applies the model kept last; ``predict`` trains a new one and then scores.
"""

from __future__ import annotations

import sys
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe import schemas
from boutframe.functions import calendar as cal
from boutframe.functions.calendar import SeasonSpan
from boutframe.learning import kept
from boutframe.learning import model as ml
from boutframe.operators import combine
from boutframe.operators.lookups import league_divisions
from boutframe.plans.jobs import Build, Inputs
from boutframe.session import build_session, discard_written, written_so_far
from boutframe.sources import store


def input_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """``name`` as a Parquet table, or else as ``name.csv`` with a declared schema."""
    stored = store.read_if_present(spark, f"{folder}/{name}")
    if stored is None:
        stored = store.read_first_csv(spark, [f"{folder}/{name}.csv"], schema)
    return store.no_nan(stored)


def optional_table(spark, folder, name, schema) -> DataFrame | None:
    try:
        return input_table(spark, folder, name, schema)
    except FileNotFoundError:
        return None


def current_step(spark: SparkSession, as_of: date) -> tuple[int, int]:
    """Season and week of a date."""
    today = F.lit(as_of)
    row = spark.range(1).select(cal.season_of(today), cal.week_of(today)).first()
    return row[0], row[1]


def build(
    spark: SparkSession,
    folder: str,
    out: str,
    span: SeasonSpan,
    rebuild_facts: bool = False,
    keep_versions: int | None = None,
) -> DataFrame:
    """Read the inputs, build all seasons, store the final table and both outputs.

    Intermediate tables are removed in the end, and older versions of the outputs if
    ``keep_versions`` says how many stay.
    """
    as_of, mark = span.as_of, written_so_far()
    season, week = current_step(spark, as_of)
    groups = optional_table(spark, folder, "divisions", schemas.DIVISIONS)
    inputs = Inputs(
        games=input_table(spark, folder, "games", schemas.GAMES),
        boxscores=input_table(spark, folder, "boxscores", schemas.BOXSCORES),
        ratings=input_table(spark, folder, "ratings", schemas.RATINGS),
        rankings_raw=input_table(spark, folder, "rankings_raw", schemas.RANKINGS_RAW),
        lines=input_table(spark, folder, "lines", schemas.LINES),
        divisions=league_divisions(spark) if groups is None else groups,
        codes=optional_table(spark, folder, "codes", schemas.CODES),
    )
    job = Build(inputs, span, season, week, f"{out}/team_games", rebuild_facts, f"{out}/form")
    job.lines, quality = job.counted_lines
    table = store.materialize(spark, f"{out}/all_data", lambda: job.all_data, True, keep_versions)
    store.materialize(spark, f"{out}/line_quality", lambda: quality, True, keep_versions)
    outputs = {"completed_games": combine.completed(table), upcoming_name(season, week): combine.to_predict(table, as_of)}
    for name, rows in outputs.items():
        store.materialize(spark, f"{out}/{name}", lambda rows=rows: rows, True, keep_versions)
    discard_written(spark, mark)
    return table


def upcoming_name(season: int, week: int) -> str:
    return f"predict/season_{season}_week_{week:02}_games_to_predict"


def train(spark: SparkSession, out: str, **options) -> DataFrame:
    """Train on the completed contests; keep the model and its holdout errors, which are returned.

    The trials of the search go to a ledger, so that a job which was lost goes on where it was.
    """
    mark = written_so_far()
    done = store.materialize(spark, f"{out}/completed_games", _missing)
    trained = ml.train(done, **{"ledger": f"{out}/search_ledger", **options})
    store.add_version(spark, f"{out}/model", trained.model.save)
    errors = store.materialize(spark, f"{out}/holdout_errors", lambda: trained.errors, force=True)
    discard_written(spark, mark)
    return errors


def score(spark: SparkSession, out: str, as_of: date) -> DataFrame:
    """Score the upcoming contests with the model kept last; nothing is fitted."""
    season, week = current_step(spark, as_of)
    coming = store.materialize(spark, f"{out}/{upcoming_name(season, week)}", _missing)
    folder = store.newest_version(spark, f"{out}/model")
    if folder is None:
        raise FileNotFoundError("no model kept; run the train job first")
    model = PipelineModel.load(folder)
    return store.materialize(spark, f"{out}/predictions", lambda: kept.scored(model, coming), force=True)


def predict(spark: SparkSession, out: str, as_of: date, **options) -> DataFrame:
    """Train on the completed contests, then score the upcoming ones."""
    train(spark, out, **options)
    return score(spark, out, as_of)


def _missing() -> DataFrame:
    raise FileNotFoundError("no contests stored; run the build job first")


def main(args: list[str]) -> None:
    spark = build_session()
    if args[0] == "build":
        as_of = date.fromisoformat(args[3])
        last, _ = current_step(spark, as_of)
        build(spark, args[1], args[2], SeasonSpan(int(args[4]), last, as_of))
    elif args[0] == "train":
        train(spark, args[1])
    elif args[0] in ("score", "predict"):
        {"score": score, "predict": predict}[args[0]](spark, args[1], date.fromisoformat(args[2]))
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
