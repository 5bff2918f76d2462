from datetime import date
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boutframe import fixed_values as fv
from boutframe.functions.calendar import SeasonSpan
from boutframe.operators import features as ft
from boutframe.operators import form as fm

SPAN = SeasonSpan(2001, 2003, as_of=date(2004, 1, 1), weeks=6)
STAT = "total_yards"
FACTS = (
    "season int, week int, team_name string, team_abbr string, points_scored double, "
    f"points_allowed double, game_won double, game_lost double, {STAT} double, "
    + ", ".join(f"{c} double" for c in fv.RATIO_INPUTS[2:])
)
SCHEDULE = (
    "away_name string, away_abbr string, home_name string, home_abbr string, "
    "season int, week int, away_game_number int, home_game_number int"
)


def league():
    """Three seasons of seven entities with byes, gaps, a rename, a newcomer and a leaver."""
    rng = random.Random(7)
    facts, schedule = [], []
    for season in (2001, 2002, 2003):
        codes = ["A", "B", "C", "D", "E", "F", "G"]
        if season == 2001:
            codes.remove("G")  # joins later
        if season == 2003:
            codes.remove("F")  # leaves
        number = defaultdict(int)
        for week in range(1, 7):
            order = codes[:]
            rng.shuffle(order)
            for away, home in zip(order[0::2], order[1::2]):
                names = [f"{c}{'-new' if c == 'B' and season == 2003 else ''}" for c in (away, home)]
                for c in (away, home):
                    number[c] += 1
                schedule.append((names[0], away, names[1], home, season, week, number[away], number[home]))
                if week == 2 and away == "C":
                    continue  # contest without any facts
                played = rng.random() > 0.2
                scores = [float(rng.randint(0, 5)) for _ in range(2)] if played else [None, None]
                for i, c in enumerate((away, home)):
                    own, foe = scores[i], scores[1 - i]
                    won = None if own is None else 1.0 if own > foe else 0.5 if own == foe else 0.0
                    downs = [float(rng.randint(0, 3)) if rng.random() > 0.3 else None for _ in range(8)]
                    facts.append(
                        (season, week, names[i], c, own, foe, won, None if won is None else 1 - won,
                         float(rng.randint(100, 400)) if rng.random() > 0.2 else None, *downs)
                    )
    # One more fact in a week: an entity may appear more than once.
    facts.append((2002, 3, "A", "A", 3.0, 1.0, 1.0, 0.0, 250.0, *[1.0] * 8))
    return facts, schedule


NAMES = [c.split()[0] for c in FACTS.split(", ")]
RATES = {
    "win_perc": ("game_won", ("game_won", "game_lost"), 0.5),
    "third_down_perc": ("third_down_conversions", ("third_down_attempts",), 0.4),
    "fourth_down_perc": ("fourth_down_conversions", ("fourth_down_attempts",), 0.5),
    "opponent_third_down_perc": ("opponent_third_down_conversions", ("opponent_third_down_attempts",), 0.4),
    "opponent_fourth_down_perc": ("opponent_fourth_down_conversions", ("opponent_fourth_down_attempts",), 0.5),
}
MEANS = ["points_scored", "points_allowed", STAT]


def form_by_weeks(facts, schedule):
    """The rules taken literally: one step after another, over all rows before it."""
    rows = [dict(zip(NAMES, f)) for f in facts]
    out, shrunk = {}, {}
    for season in (2001, 2002, 2003):
        listed = {c for s in schedule if s[4] == season for c in (s[1], s[3])}
        for week in range(1, 7):
            prior = [r for r in rows if r["season"] == season - 1]
            if week == 1:
                history = prior
            else:
                history = [r for r in rows if r["season"] == season and r["week"] < week]
                absent = listed - {r["team_abbr"] for r in history}
                history = history + [r for r in prior if r["team_abbr"] in absent]
            groups = defaultdict(list)
            for r in history:
                groups[r["team_name"], r["team_abbr"]].append(r)
            step = {}
            for key, members in groups.items():
                form = {}
                total = {c: sum(m[c] or 0.0 for m in members) for c in fv.RATIO_INPUTS}
                for name, (part, whole, default) in RATES.items():
                    n = sum(total[w] for w in whole)
                    form[name] = total[part] / n if n > 0 else default
                for c in MEANS:
                    known = [m[c] for m in members if m[c] is not None]
                    form[c] = sum(known) / len(known) if known else None
                step[key] = form
            starts = {
                c for s in schedule if (s[4], s[5]) == (season, week)
                for c, n in ((s[1], s[6]), (s[3], s[7])) if n == 1
            }
            for name in [*RATES, *MEANS]:
                known = [f[name] for f in step.values() if f[name] is not None]
                mean = sum(known) / len(known) if known else None
                for key, form in step.items():
                    out.setdefault((season, week, *key), {})[name] = form[name]
                    v = form[name]
                    if key[1] in starts:
                        v = None if v is None else mean / 3 + 2 * v / 3
                    shrunk.setdefault((season, week, *key), {})[name] = v
    return out, shrunk


@pytest.fixture(scope="module")
def tables(spark):
    facts, schedule = league()
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(schedule, SCHEDULE)


def as_dict(df):
    return {(r["season"], r["week"], r["team_name"], r["team_abbr"]): r for r in df.collect()}


def assert_same(found, expected):
    assert set(found) == set(expected)
    for key, stats in expected.items():
        for name, value in stats.items():
            got = found[key][name]
            assert got == (value if value is None else pytest.approx(value, abs=1e-9)), (key, name)


def test_raw_form_equals_the_week_by_week_loop(tables):
    raw, _ = form_by_weeks(*league())
    assert_same(as_dict(fm.raw_form(*tables, SPAN)), raw)


def test_shrunk_form_equals_the_week_by_week_loop(tables):
    _, shrunk = form_by_weeks(*league())
    assert_same(as_dict(fm.entity_form(*tables, SPAN)), shrunk)


def test_written_and_lazy_form_agree(tables):
    written, lazy = (fm.entity_form(*tables, SPAN, write=w) for w in (True, False))
    assert written.exceptAll(lazy).count() == 0 == lazy.exceptAll(written).count()


def test_later_weeks_do_not_leak(tables):
    facts, schedule = tables
    late = (F.col("season") == 2003) & (F.col("week") >= 4)
    changed = facts.withColumn(STAT, F.when(late, F.col(STAT) + 1000).otherwise(F.col(STAT)))
    early = "season < 2003 OR week <= 4"
    before = fm.raw_form(facts, schedule, SPAN).where(early)
    after = fm.raw_form(changed, schedule, SPAN).where(early)
    assert before.exceptAll(after).count() == 0


def test_fallback_follows_the_code_through_a_rename(tables):
    rows = as_dict(fm.raw_form(*tables, SPAN))
    assert rows[2003, 1, "B", "B"]["from_prior"]
    own = [k for k, r in rows.items() if k[0] == 2003 and k[3] == "B" and not r["from_prior"]]
    assert own and all(k[2] == "B-new" for k in own)


def test_first_season_has_no_week_one(tables):
    assert fm.raw_form(*tables, SPAN).where("season = 2001 AND week = 1").count() == 0


def test_shrinkage_value(spark):
    form = spark.createDataFrame(
        [(2001, 2, "a", "a", False, True, 26.0), (2001, 2, "b", "b", False, False, 14.0)],
        "season int, week int, team_name string, team_abbr string, from_prior boolean, starting boolean, x double",
    )
    values = {r["team_abbr"]: r["x"] for r in fm.shrink_first_games(form, SPAN).collect()}
    assert values == {"a": pytest.approx(24.0), "b": 14.0}


def test_only_null_sums_are_zero_and_nameless_rows_drop(spark):
    rows = [("a", "a", None), ("a", "a", None), (None, "b", 1.0)]
    facts = spark.createDataFrame(rows, "team_name string, team_abbr string, game_won double")
    sums = fm.ratio_sums(facts, fm.ENTITY).collect()
    assert len(sums) == 1
    assert all(sums[0][c] == 0.0 for c in fv.RATIO_INPUTS)


def test_entities_without_history(tables):
    facts, schedule = tables
    found = {tuple(r) for r in fm.entities_without_history(facts, schedule, SPAN).collect()}
    rows = [dict(zip(NAMES, f)) for f in league()[0]]
    expected = set()
    for s in (2001, 2002, 2003):
        listed = {c for g in league()[1] if g[4] == s for c in (g[1], g[3])}
        for w in range(2, 7):
            seen = {r["team_abbr"] for r in rows if r["season"] == s and r["week"] < w}
            expected |= {(s, c, w) for c in listed - seen}
    assert found == expected


def test_busy_entity_is_reduced_before_the_windows(spark):
    """One entity holding most facts reaches the windows as one row per week."""
    many = spark.range(20000).selectExpr(
        "2001 AS season", "cast(id % 6 + 1 AS int) AS week", "'hot' AS team_name", "'hot' AS team_abbr",
        "cast(id % 40 AS double) AS points_scored", "cast(id % 2 AS double) AS game_won",
    )
    weekly = fm.weekly_totals(many, SPAN)
    assert weekly.count() == 6
    form = fm.raw_form(many, spark.createDataFrame([], SCHEDULE), SPAN)
    row = form.where("season = 2001 AND week = 6").first()
    assert row["game_won"] == many.where("week < 6").agg(F.sum("game_won")).first()[0]
    assert row["points_scored"] == pytest.approx(many.where("week < 6").agg(F.avg("points_scored")).first()[0])


def test_differences(spark):
    values = {f"{side}_{s}": float(i) * (2 if side == "away" else 1) for i, s in enumerate(ft.COMPARED) for side in ("away", "home")}
    out = ft.stat_differences(spark.createDataFrame([tuple(values.values())], list(values))).first()
    assert len(ft.COMPARED) == 44
    assert all(out[f"{s}_diff"] == float(i) for i, s in enumerate(ft.COMPARED))
