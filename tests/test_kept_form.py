"""Refreshed form and features equal those built anew, and only due partitions are read and replaced."""

import re

import pytest
from pyspark.sql import functions as F

from boutframe.operators import features as ft
from boutframe.operators import form as fm
from boutframe.operators import kept_form
from boutframe.operators.kept_form import KeptForm
from boutframe.plans.catalogue import build
from boutframe.plans.domain import SPAN
from boutframe.session import written

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    b = build(spark, ROOT)
    return written(b.coded_facts, "test-facts"), written(b.coded_schedule, "test-schedule")


def rows(df):
    """Rows with doubles rounded, in an order of their own."""
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    names = sorted(df.columns)
    shown = df.select(*[F.round(c, 9).alias(c) if c in doubles else F.col(c) for c in names])
    return sorted(map(str, shown.collect()))


def same_as_anew(spark, kept, facts, schedule):
    form = fm.raw_form(facts, schedule, SPAN)
    assert rows(kept.form(spark)) == rows(form.select(kept.form(spark).columns))
    features = ft.features_of(schedule, facts, fm.shrink_first_games(form, SPAN), SPAN)
    assert rows(kept.features(spark)) == rows(features.select(kept.features(spark).columns))


def partitions(df):
    found = {f: tuple(p.split("=")[1] for p in f.split("/")[-3:-1]) for f in df.inputFiles()}
    return found


CHANGES = {
    "a week's points": ({(1999, 7)}, lambda f, s: (f.withColumn("points_scored", F.when(F.expr("season = 1999 AND week = 7"), 3).otherwise(F.col("points_scored"))), s)),
    "a step gone": ({(1997, 3)}, lambda f, s: (f.where("NOT (season = 1997 AND week = 3)"), s)),
    "a first week no longer listed": ({(1998, 1), (1998, 2)}, lambda f, s: (f.where("NOT (season = 1998 AND week < 3)"), s.where("NOT (season = 1998 AND week < 3)"))),
    "the last season": ({(2001, 10), (2001, 11)}, lambda f, s: (f.where("NOT (season = 2001 AND week > 9)"), s)),
}


@pytest.mark.parametrize("name", sorted(CHANGES))
def test_refresh_equals_rebuild(spark, tables, tmp_path, monkeypatch, name):
    facts, schedule = tables
    changed, before = CHANGES[name]
    kept = KeptForm(f"file://{tmp_path}/form", SPAN)
    first = before(facts, schedule)
    kept.refresh(*first)
    same_as_anew(spark, kept, *first)
    old = {t: partitions(spark.read.parquet(f"{kept.folder}/{t}")) for t in ("totals", "form")}

    read, running = [], kept_form.running_form
    monkeypatch.setattr(kept_form, "running_form", lambda totals, listings: read.append(totals) or running(totals, listings))
    kept.refresh(facts, schedule, changed)
    same_as_anew(spark, kept, facts, schedule)
    # The state of the season, of the one before and of the two after is read, nothing else.
    season = next(iter(changed))[0]
    assert {r[0] for r in read[0].select("season").distinct().collect()} <= {season + k for k in (-1, 0, 1, 2)}
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*season#\d+ (IN|INSET) ", plan)
    new = {t: partitions(spark.read.parquet(f"{kept.folder}/{t}")) for t in ("totals", "form")}
    replaced = {t: {p for f, p in {**old[t], **new[t]}.items() if (f in old[t]) != (f in new[t])} for t in old}
    assert replaced["totals"] <= {(str(s), str(w)) for s, w in changed}
    assert {s for s, _ in replaced["form"]} <= {str(season), str(season + 1)}
    if name in ("a week's points", "a step gone"):  # the entities listed are the same
        assert min(int(w) for s, w in replaced["form"] if s == str(season)) == min(w for _, w in changed) + 1


def test_nothing_changed_and_nothing_there(spark, tables, tmp_path):
    facts, schedule = tables
    kept = KeptForm(f"file://{tmp_path}/form", SPAN)
    kept.refresh(facts, schedule, {(1999, 3)})  # nothing is stored yet, so all is computed
    same_as_anew(spark, kept, facts, schedule)
    files = set(kept.form(spark).inputFiles())
    kept.refresh(facts, schedule, set())
    assert set(kept.form(spark).inputFiles()) == files
