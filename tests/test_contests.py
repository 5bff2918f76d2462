from datetime import date

from boutframe import fixed_values as fv
from boutframe import schemas
from boutframe.operators import contests as ct


def game(contest, season, week, away, home, away_score, home_score):
    return (contest, season, week, away.upper(), away, away_score, home.upper(), home, home_score)


def box(contest, away_yards, home_yards):
    def side(yards):
        return [
            "30:30" if s == "time_of_possession" else float(yards if s == "total_yards" else i)
            for i, s in enumerate(fv.BOXSCORE_STATS)
        ]

    return (contest, *side(away_yards), *side(home_yards))


GAMES = [
    game("20240908bbb", 2024, 1, "aaa", "bbb", 20.0, 17.0),
    game("20240908ddd", 2024, 1, "ccc", "ddd", 17.0, 17.0),
    game("20240915aaa", 2024, 2, "ccc", "aaa", None, 3.0),
    game("20240922aaa", 2024, 3, "bbb", "aaa", None, None),
    game("20241201ccc", 2024, 13, "bbb", "ccc", 10.0, 3.0),
    game("20240211ddd", 2024, 4, "aaa", "ddd", 1.0, 2.0),
]
BOXES = [box(g[0], 100 + i, 200 + i) for i, g in enumerate(GAMES) if g[0] != "20240908ddd"]


def tables(spark):
    return (
        spark.createDataFrame(GAMES, schemas.GAMES),
        spark.createDataFrame(BOXES, schemas.BOXSCORES),
    )


def facts(spark):
    games, boxes = tables(spark)
    rows = ct.team_games(games, boxes, as_of=date(2024, 11, 1)).collect()
    return {(r["week"], r["team_abbr"]): r for r in rows}


def test_two_rows_per_contest_of_the_season(spark):
    rows = facts(spark)
    assert len(rows) == 10  # the February contest belongs to another season
    assert (4, "aaa") not in rows


def test_outcomes_and_scores(spark):
    rows = facts(spark)
    win, loss = rows[1, "aaa"], rows[1, "bbb"]
    assert (win["game_won"], win["game_lost"]) == (1.0, 0.0)
    assert (loss["game_won"], loss["points_scored"], loss["points_allowed"]) == (0.0, 17.0, 20.0)
    assert {rows[1, t]["game_won"] for t in ("ccc", "ddd")} == {0.5}
    for side in ("ccc", "aaa"):  # only one score known: both go
        r = rows[2, side]
        assert (r["game_won"], r["points_scored"], r["points_allowed"]) == (None, None, None)


def test_stats_and_mirror(spark):
    rows = facts(spark)
    r = rows[1, "aaa"]
    assert (r["total_yards"], r["opponent_total_yards"], r["time_of_possession"]) == (100.0, 200.0, 1830.0)
    assert rows[1, "bbb"]["total_yards"] == 200.0
    assert rows[2, "ccc"]["total_yards"] == 102.0  # one score known: stats are used


def test_placeholders(spark):
    rows = facts(spark)
    for key in [(1, "ccc"), (3, "aaa"), (13, "bbb")]:  # no box score, no scores, future
        assert all(rows[key][s] is None for s in fv.BOXSCORE_STATS)


def test_column_order(spark):
    games, boxes = tables(spark)
    names = ct.team_games(games, boxes, date(2025, 1, 1)).columns
    assert names[:6] == ["team_name", "team_abbr", "points_scored", "points_allowed", "game_won", "game_lost"]
    assert names[6:29] == fv.BOXSCORE_STATS
    assert names[-2:] == ["week", "season"]
    assert len(names) == 6 + 23 + 22 + 2


def test_long_mirror_equals_wide_mirror(spark):
    _, boxes = tables(spark)
    stats = ["total_yards", "fumbles"]
    long = ct.side_stats(boxes, "away", stats).unionByName(ct.side_stats(boxes, "home", stats))
    mirrored = ct.opponent_mirror(long, ["boxscore_id"], stats)
    assert mirrored.count() == 2 * len(BOXES)
    assert mirrored.where("total_yards + opponent_total_yards <> 2 * least(total_yards, opponent_total_yards) + 100").count() == 0


def test_game_numbers_skip_byes_and_restart_each_season(spark):
    rows = [
        game("20240908b", 2024, 1, "a", "b", None, None),
        game("20240922a", 2024, 3, "c", "a", None, None),
        game("20240929a", 2024, 4, "b", "a", None, None),
        game("20250908b", 2025, 1, "a", "b", None, None),
    ]
    out = ct.numbered_schedule(spark.createDataFrame(rows, schemas.GAMES)).collect()
    found = {(r["season"], r["week"]): (r["away_game_number"], r["home_game_number"]) for r in out}
    assert found == {(2024, 1): (1, 1), (2024, 3): (1, 2), (2024, 4): (2, 3), (2025, 1): (1, 1)}
