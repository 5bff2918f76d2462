"""The catalogue's results as DuckDB SQL over the same tables.

Written from the rules, not from the Spark plans: form, for one, is computed here step
by step from all earlier rows, where the Spark side uses one window pass.
"""

from __future__ import annotations

import re

from boutframe import fixed_values as fv
from boutframe.functions.odds import FRACTION_TERMS, SERIES_TERMS, TAIL_FROM
from boutframe.operators.features import COMPARED
from boutframe.plans.catalogue import (
    CODE_POOL,
    LINE_ITEM_FEATURES,
    MIRRORED,
)
from boutframe.plans.domain import LABELS, LEGACY_NAMES, METRICS, NAMED, QUOTE_RULES

STATS = fv.BOXSCORE_STATS
OPPONENT = [s for s in STATS if s != "time_of_possession"]
FACT_STATS = [*STATS, *[f"opponent_{s}" for s in OPPONENT]]
MEANS = sorted(
    {"points_scored", "points_allowed", *FACT_STATS} - set(fv.RATIO_INPUTS)
)
RATE_NAMES = [
    "win_perc", "third_down_perc", "fourth_down_perc",
    "opponent_third_down_perc", "opponent_fourth_down_perc",
]
FORM = sorted([*MEANS, *RATE_NAMES])


# --- text helpers ----------------------------------------------------------
def text_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def text_map(pairs) -> str:
    return f"map({text_list(pairs)}, {text_list(pairs.values())})"


def pick(items, position) -> str:
    return f"list_extract({text_list(items)}, CAST({position} + 1 AS BIGINT))"


def code(items, key) -> str:
    return f"CASE WHEN {key} < {NAMED} THEN {pick(items, key)} ELSE 'E' || {key} END"


def look(pairs, value, keep=True) -> str:
    found = f"{text_map(pairs)}[{value}]"
    return f"coalesce({found}, {value})" if keep else found


def pmod(x, n) -> str:
    return f"((({x}) % ({n})) + ({n})) % ({n})"


def season_start(year) -> str:
    first = f"make_date(CAST({year} AS BIGINT), 9, 1)"
    return f"({first} + CAST((8 - isodow({first})) % 7 + 3 AS INTEGER))"


def anchor(year) -> str:
    return f"({season_start(year)} - 2)"


def season_of(day) -> str:
    return f"(year({day}) - CASE WHEN month({day}) <= 2 THEN 1 ELSE 0 END)"


def week_of(day) -> str:
    def since(a):
        return f"greatest(1, least(18, CAST(floor(({day} - {a}) / 7.0) AS INTEGER) + 1))"

    now, before = anchor(f"year({day})"), anchor(f"year({day}) - 1")
    return (
        f"CASE WHEN {day} >= {now} THEN {since(now)} "
        f"WHEN month({day}) <= 2 THEN {since(before)} ELSE 1 END"
    )


def week_start(season, week) -> str:
    return f"({season_start(season)} + CAST({week} * 7 - 8 AS INTEGER))"


def step_of(ts) -> str:
    return (
        f"CAST(year({ts}) AS INTEGER) AS season, "
        f"CAST(least(18, floor((dayofyear({ts}) - 1) / 20) + 1) AS INTEGER) AS week"
    )


def number(text) -> str:
    """Decimal numbers; words that engines read as numbers are none."""
    return (
        f"CASE WHEN regexp_full_match({text}, '\\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\\s*') "
        f"THEN coalesce(TRY_CAST({text} AS DOUBLE), 0.0) ELSE 0.0 END"
    )


def clock(c) -> str:
    return f"(TRY_CAST(split_part({c}, ':', 1) AS DOUBLE) * 60 + TRY_CAST(split_part({c}, ':', 2) AS DOUBLE))"


def normal_cdf(z) -> str:
    series = "1.0::DOUBLE"
    for k in range(SERIES_TERMS, 0, -1):
        series = f"(1 + {z} * {z} / {2 * k + 1} * {series})"
    far = f"greatest(abs({z}), {TAIL_FROM}::DOUBLE)"
    fraction = far
    for k in range(FRACTION_TERMS, 0, -1):
        fraction = f"({far} + {k}::DOUBLE / {fraction})"
    density = f"(exp({z} * {z} * -0.5) / sqrt(2 * pi()))"
    return (
        f"CASE WHEN abs({z}) <= {TAIL_FROM} THEN 0.5 + {density} * {z} * {series} "
        f"WHEN {z} < 0 THEN {density} / {fraction} ELSE 1 - {density} / {fraction} END"
    )


def usable(line, prices) -> str:
    ok = [f"({p} IS NULL OR {p} BETWEEN -400 AND 400)" for p in prices]
    return " AND ".join([f"{line} IS NOT NULL", *ok])


def mixed(key) -> str:
    folded = f"(CAST({key} AS BIGINT) % 2147483647)"
    return f"(({folded} * 2654435761 + 42 * 40503) % 4294967296)"


def bucket(mix, n) -> str:
    return f"(({mix} * {n}) // 4294967296)"


def r6(expr, name) -> str:
    return f"round_even(({expr}) * 1000000, 0) / 1000000 AS {name}"


def cols(names) -> str:
    return ", ".join(names)


DATES = "BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-12-31 23:59:59'"
N = "(SELECT max(s_suppkey) + 1 FROM supplier)"
ODD = f"({N} + (1 - {N} % 2))"


def foe(key) -> str:
    return pmod(f"week + season * 18 - {key}", ODD)


NAME = (
    "CASE WHEN {k} < " + str(len(LEGACY_NAMES)) + " THEN " + pick(LEGACY_NAMES, "{k}")
    + " ELSE 'Entity ' || {k} END"
)


def name_of(key) -> str:
    return NAME.replace("{k}", key)


# --- shared tables -----------------------------------------------------------
CTE: dict[str, str] = {}

CTE["steps"] = """
SELECT CAST(s AS INTEGER) AS season, CAST(w AS INTEGER) AS week
FROM range(1995, 2002) a(s), range(1, 19) b(w)"""

CTE["pairings"] = f"""
SELECT season, week, CASE WHEN (lo + season + week) % 2 = 0 THEN lo ELSE hi END AS away_key,
       CASE WHEN (lo + season + week) % 2 = 0 THEN hi ELSE lo END AS home_key,
       {season_start('season')} + CAST((week - 1) * 7 + lo % 4 AS INTEGER) AS day
FROM (SELECT s_suppkey AS lo, season, week, {foe('s_suppkey')} AS hi FROM supplier, steps)
WHERE lo < hi AND hi < {N}"""

CTE["entity_stats"] = f"""
SELECT season, week, key,
  CAST(n + lines AS DOUBLE) AS first_downs, CAST(lines AS DOUBLE) AS rush_attempts,
  CAST(parts AS DOUBLE) AS rush_yards, CAST(ret AS DOUBLE) AS rush_touchdowns,
  CAST(n + acc AS DOUBLE) AS pass_completions, CAST(2 * n + lines AS DOUBLE) AS pass_attempts,
  CAST(qty AS DOUBLE) AS pass_yards, CAST(done AS DOUBLE) AS pass_touchdowns,
  CAST(disc AS DOUBLE) AS interceptions, CAST(digits AS DOUBLE) AS times_sacked,
  CAST(digits * 7 AS DOUBLE) AS yards_lost_from_sacks, CAST(qty - digits AS DOUBLE) AS net_pass_yards,
  CAST(qty + parts AS DOUBLE) AS total_yards, CAST(tax AS DOUBLE) AS fumbles,
  CAST(least(tax, n) AS DOUBLE) AS fumbles_lost, CAST(disc + tax AS DOUBLE) AS turnovers,
  CAST(most AS DOUBLE) AS penalties, CAST(most * 5 + fewest AS DOUBLE) AS yards_from_penalties,
  CAST(ret AS DOUBLE) AS third_down_conversions, CAST(n AS DOUBLE) AS third_down_attempts,
  CAST(both_ AS DOUBLE) AS fourth_down_conversions, CAST(acc AS DOUBLE) AS fourth_down_attempts,
  lpad(CAST(((qty * 13 + n * 7) % 3600) // 60 AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(((qty * 13 + n * 7) % 3600) % 60 AS VARCHAR), 2, '0') AS time_of_possession
FROM (SELECT {step_of('l_shipdate')}, l_suppkey AS key, count(*) AS n,
        CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(sum(l_linenumber) AS BIGINT) AS lines,
        CAST(sum(l_partkey % 100) AS BIGINT) AS parts, CAST(sum(l_orderkey % 10) AS BIGINT) AS digits,
        CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
        CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
        CAST(max(l_quantity) AS BIGINT) AS most, CAST(min(l_quantity) AS BIGINT) AS fewest,
        count(*) FILTER (l_returnflag = 'R') AS ret, count(*) FILTER (l_returnflag = 'A') AS acc,
        count(*) FILTER (l_linestatus = 'F') AS done,
        count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS both_
      FROM lineitem WHERE l_shipdate {DATES} GROUP BY 1, 2, 3)"""

CTE["entity_scores"] = f"""
SELECT {step_of('o_orderdate')}, o_custkey % {N} AS key,
       CAST(CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) % 60 AS DOUBLE) AS points
FROM orders WHERE o_orderdate {DATES} GROUP BY 1, 2, 3"""

CTE["games"] = f"""
SELECT strftime(day, '%Y%m%d') || {code(fv.BOXSCORE_CODES, 'home_key')} AS boxscore_id,
  p.season, p.week, day, away_key, home_key,
  {name_of('away_key')} AS away_name, {code(fv.BOXSCORE_CODES, 'away_key')} AS away_abbr,
  CASE WHEN day <= DATE '2001-11-14' THEN a.points END AS away_score,
  {name_of('home_key')} AS home_name, {code(fv.BOXSCORE_CODES, 'home_key')} AS home_abbr,
  CASE WHEN day <= DATE '2001-11-14' THEN h.points END AS home_score
FROM pairings p
LEFT JOIN entity_scores a ON a.season = p.season AND a.week = p.week AND a.key = away_key
LEFT JOIN entity_scores h ON h.season = p.season AND h.week = p.week AND h.key = home_key"""

CTE["boxscores"] = f"""
SELECT strftime(day, '%Y%m%d') || {code(fv.BOXSCORE_CODES, 'home_key')} AS boxscore_id,
  {cols(f'a.{s} AS away_{s}' for s in STATS)}, {cols(f'h.{s} AS home_{s}' for s in STATS)}
FROM pairings p
JOIN entity_stats a ON a.season = p.season AND a.week = p.week AND a.key = away_key
JOIN entity_stats h ON h.season = p.season AND h.week = p.week AND h.key = home_key"""

CTE["attached"] = f"""
SELECT g.*, {cols(f'b.{side}_{s}' for side in ('away', 'home') for s in STATS)}
FROM games g LEFT JOIN boxscores b ON b.boxscore_id = g.boxscore_id
 AND g.day <= DATE '2001-11-14' AND (g.away_score IS NOT NULL OR g.home_score IS NOT NULL)"""


def side_select(side, stats=True) -> str:
    other = "home" if side == "away" else "away"
    own, foe_ = f"{side}_score", f"{other}_score"
    both = f"{own} IS NOT NULL AND {foe_} IS NOT NULL"
    won = f"CASE WHEN {own} > {foe_} THEN 1.0 WHEN {own} = {foe_} THEN 0.5 WHEN {own} < {foe_} THEN 0.0 END"
    lost = f"CASE WHEN {own} > {foe_} THEN 0.0 WHEN {own} = {foe_} THEN 0.5 WHEN {own} < {foe_} THEN 1.0 END"
    out = [
        f"{side}_name AS team_name", f"{side}_abbr AS team_abbr",
        f"CASE WHEN {both} THEN {own} END AS points_scored",
        f"CASE WHEN {both} THEN {foe_} END AS points_allowed",
        f"CAST({won} AS DOUBLE) AS game_won", f"CAST({lost} AS DOUBLE) AS game_lost",
    ]
    if stats:
        out += [
            f"{clock(f'{side}_{s}') if s == 'time_of_possession' else f'{side}_{s}'} AS {s}" for s in STATS
        ]
        out += [f"{other}_{s} AS opponent_{s}" for s in OPPONENT]
    return cols([*out, "week", "season"])


CTE["facts"] = f"""
SELECT {side_select('away')} FROM attached UNION ALL SELECT {side_select('home')} FROM attached"""

CTE["base_facts"] = f"""
SELECT {side_select('away', False)} FROM games UNION ALL SELECT {side_select('home', False)} FROM games"""

STD = dict(zip(fv.BOXSCORE_CODES, fv.STANDARD_CODES))
CTE["coded_facts"] = f"SELECT * REPLACE ({look(STD, 'team_abbr')} AS team_abbr) FROM facts"
CTE["coded_games"] = f"""
SELECT * REPLACE ({look(STD, 'away_abbr')} AS away_abbr, {look(STD, 'home_abbr')} AS home_abbr) FROM games"""

CTE["numbers"] = """
SELECT season, week, team_abbr,
       CAST(row_number() OVER (PARTITION BY season, team_abbr ORDER BY week) AS INTEGER) AS game_number
FROM (SELECT season, week, away_abbr AS team_abbr FROM games
      UNION ALL SELECT season, week, home_abbr FROM games)"""

CTE["numbered"] = """
SELECT g.away_name, g.away_abbr, g.home_name, g.home_abbr, g.season, g.week,
       a.game_number AS away_game_number, h.game_number AS home_game_number
FROM games g
LEFT JOIN numbers a ON a.season = g.season AND a.week = g.week AND a.team_abbr = g.away_abbr
LEFT JOIN numbers h ON h.season = g.season AND h.week = g.week AND h.team_abbr = g.home_abbr"""

CTE["coded_numbers"] = f"""
SELECT * REPLACE ({look(STD, 'team_abbr')} AS team_abbr) FROM numbers"""

CTE["scheduled"] = """
SELECT DISTINCT season, team_abbr FROM coded_numbers"""


def history(facts) -> str:
    """Rows that make up the history before each step, one step at a time."""
    return f"""
SELECT t.season AS at_season, t.week AS at_week, false AS from_prior, f.*
FROM steps t JOIN {facts} f ON f.season = t.season AND f.week < t.week
UNION ALL
SELECT t.season, t.week, true, f.*
FROM steps t JOIN {facts} f ON f.season = t.season - 1
WHERE t.week = 1
   OR (EXISTS (SELECT 1 FROM scheduled s WHERE s.season = t.season AND s.team_abbr = f.team_abbr)
       AND NOT EXISTS (SELECT 1 FROM first_weeks e WHERE e.season = t.season
                       AND e.team_abbr = f.team_abbr AND e.first_week < t.week))"""


CTE["first_weeks"] = """
SELECT season, team_abbr, min(week) AS first_week FROM coded_facts GROUP BY 1, 2"""

RATES_SQL = cols(
    [
        "CASE WHEN game_won + game_lost > 0 THEN game_won / (game_won + game_lost) ELSE 0.5 END AS win_perc",
        *[
            f"CASE WHEN {p}{d}_attempts > 0 THEN {p}{d}_conversions / {p}{d}_attempts ELSE {v} END AS {p}{d}_perc"
            for p in ("", "opponent_")
            for d, v in (("third_down", 0.4), ("fourth_down", 0.5))
        ],
    ]
)
SUMS_SQL = cols(f"coalesce(sum({c}), 0.0) AS {c}" for c in fv.RATIO_INPUTS)
MEANS_SQL = cols(f"avg({c}) AS {c}" for c in MEANS)

CTE["history"] = history("coded_facts")
CTE["raw_form"] = f"""
SELECT *, {RATES_SQL} FROM (
  SELECT at_season AS season, at_week AS week, team_name, team_abbr, from_prior, {SUMS_SQL}, {MEANS_SQL}
  FROM history GROUP BY 1, 2, 3, 4, 5)"""

CTE["league"] = f"""
SELECT season, week, {cols(f'avg({s}) AS league_{s}' for s in FORM)} FROM raw_form GROUP BY 1, 2"""

THIRD = "(1.0::DOUBLE / 3.0::DOUBLE)"
CTE["form"] = f"""
SELECT r.season, r.week, r.team_name, r.team_abbr, r.from_prior, {cols(f'r.{c}' for c in fv.RATIO_INPUTS)},
  {cols(f'CASE WHEN n.game_number = 1 THEN {THIRD} * league_{s} + (1 - {THIRD}) * r.{s} ELSE r.{s} END AS {s}' for s in FORM)}
FROM raw_form r JOIN league l ON l.season = r.season AND l.week = r.week
LEFT JOIN coded_numbers n ON n.season = r.season AND n.week = r.week AND n.team_abbr = r.team_abbr"""

CTE["features"] = f"""
SELECT {look(STD, 'g.away_abbr')} AS away_abbr, {look(STD, 'g.home_abbr')} AS home_abbr,
  g.away_name, g.home_name, g.season, g.week, g.away_game_number, g.home_game_number,
  {cols(f'a.{s} AS away_{s}, h.{s} AS home_{s}, a.{s} - h.{s} AS {s}_diff' for s in COMPARED)},
  f.points_scored AS away_score, f.points_allowed AS home_score, f.game_won AS result
FROM numbered g
LEFT JOIN form a ON a.season = g.season AND a.week = g.week AND a.team_abbr = {look(STD, 'g.away_abbr')}
LEFT JOIN form h ON h.season = g.season AND h.week = g.week AND h.team_abbr = {look(STD, 'g.home_abbr')}
LEFT JOIN coded_facts f ON f.season = g.season AND f.week = g.week AND f.team_name = g.away_name
 AND f.team_abbr = {look(STD, 'g.away_abbr')}
WHERE NOT (g.season = 1995 AND g.week = 1)"""


# --- lines ---------------------------------------------------------------------
def quote_rule(rule) -> str:
    return rule.replace("2.0D", "2.0::DOUBLE")


CTE["quotes"] = f"""
SELECT season, week, o_orderkey,
  {code(fv.RATING_CODES, 'home_key')} AS home_team, {code(fv.RATING_CODES, 'away_key')} AS away_team,
  {cols(f'CAST({quote_rule(rule)} AS DOUBLE) AS {name}' for name, rule in QUOTE_RULES.items())}
FROM (SELECT *, CASE WHEN (least(key, foe) + season + week) % 2 = 0 THEN least(key, foe) ELSE greatest(key, foe) END AS away_key,
             CASE WHEN (least(key, foe) + season + week) % 2 = 0 THEN greatest(key, foe) ELSE least(key, foe) END AS home_key
      FROM (SELECT *, {foe('key')} AS foe FROM (
        SELECT {step_of('o_orderdate')}, o_orderkey, o_custkey, o_custkey % {N} AS key,
               CAST(floor(o_totalprice) AS BIGINT) AS cents FROM orders)))
WHERE foe < {N} AND foe <> key"""

CTE["closing"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY season, week, home_team, away_team ORDER BY o_orderkey DESC) AS rn
  FROM quotes) WHERE rn = 1"""

VALID = (
    "coalesce(home_spread_last, home_spread_open) IS NOT NULL "
    "AND coalesce(total_line_last, total_line_open) IS NOT NULL"
)


def chosen(source) -> str:
    last_s = usable("home_spread_last", ["home_spread_last_price", "away_spread_last_price"])
    open_s = usable("home_spread_open", ["home_spread_open_price", "away_spread_open_price"])
    last_t = usable("total_line_last", ["under_price_last", "over_price_last"])
    open_t = usable("total_line_open", ["under_price_open", "over_price_open"])
    return f"""
SELECT *, 0.0 - home_spread AS away_spread,
  CASE WHEN spread_source = 'open' OR total_line_source = 'open' THEN 'open' ELSE spread_source END AS moneyline_source
FROM (SELECT *, {VALID} AS ok,
  CASE WHEN {last_s} THEN home_spread_last WHEN {open_s} THEN home_spread_open ELSE 0.0 END AS home_spread,
  CASE WHEN {last_s} THEN 'last' WHEN {open_s} THEN 'open' ELSE 'default' END AS spread_source,
  CASE WHEN {last_t} THEN total_line_last WHEN {open_t} THEN total_line_open ELSE 44.0 END AS total_line,
  CASE WHEN {last_t} THEN 'last' WHEN {open_t} THEN 'open' ELSE 'default' END AS total_line_source
  FROM {source})"""


def quoted(side) -> str:
    return (
        f"CASE moneyline_source WHEN 'last' THEN {side}_ml_last WHEN 'open' THEN {side}_ml_open END"
    )


def priced(source) -> str:
    """Moneylines; the two chances are computed once per row in a subquery."""
    computed = {
        s: f"round_even(CASE WHEN {s}_spread < 0 THEN -100 * {s}_q / (1 - {s}_q) ELSE 100 * (1 - {s}_q) / {s}_q END, 0)"
        for s in ("home", "away")
    }
    return f"""
SELECT *, {cols(f'coalesce({quoted(s)}, {computed[s]}) AS {s}_moneyline' for s in ('home', 'away'))}
FROM (SELECT *, {cols(f"({normal_cdf(f'{s}_z')}) * 1.05 AS {s}_q" for s in ('home', 'away'))}
  FROM (SELECT *, {cols(f'-{s}_spread / {fv.MARGIN_STD_DEV} AS {s}_z' for s in ('home', 'away'))}
    FROM {source} WHERE ok))"""


CTE["chosen_quotes"] = chosen("quotes")
CTE["priced_quotes"] = priced("chosen_quotes")
CTE["chosen_closing"] = chosen("closing")
CTE["priced_closing"] = priced("chosen_closing")
CTE["code_lookup"] = f"""
SELECT {code(fv.RATING_CODES, 's_suppkey')} AS alias, {code(fv.STANDARD_CODES, 's_suppkey')} AS abbr
FROM supplier WHERE s_suppkey % 17 <> 5"""


def final_lines(source) -> str:
    return f"""
SELECT a.abbr AS away_abbr, h.abbr AS home_abbr, season, week, away_spread, home_spread,
       away_moneyline, home_moneyline, total_line
FROM {source} LEFT JOIN code_lookup a ON a.alias = away_team LEFT JOIN code_lookup h ON h.alias = home_team"""


CTE["contest_lines"] = final_lines("priced_closing")

# --- ratings, rankings, groups ---------------------------------------------------
ANY = {
    **dict(zip(fv.RATING_CODES, fv.STANDARD_CODES)),
    **{c: c for c in fv.STANDARD_CODES},
    **fv.CODE_ALIASES,
}


def figures(key, n) -> str:
    return (
        f"CAST(1300 + ({key} * 37 + week * 11) % 400 AS DOUBLE) AS elo{n}_pre, "
        f"CAST(1310 + ({key} * 41 + week * 13) % 380 AS DOUBLE) AS qbelo{n}_pre, "
        f"CAST(({key} * 7 + week * 3) % 250 AS DOUBLE) AS qb{n}_value_pre, "
        f"'QB ' || ({key} % 97) AS qb{n}"
    )


CTE["one_way"] = f"""
SELECT day AS date, week, CAST(CASE WHEN (away_key + home_key) % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS neutral,
  {look(ANY, '(' + code(fv.RATING_CODES, 'k1') + ')')} AS team1,
  {look(ANY, '(' + code(fv.RATING_CODES, 'k2') + ')')} AS team2,
  {figures('k1', 1)}, {figures('k2', 2)}, CAST(NULL AS DOUBLE) AS surface_factor,
  CAST({season_of('day')} AS INTEGER) AS season
FROM (SELECT * REPLACE (CASE WHEN (away_key + home_key) % 31 = 0 THEN day + 200 ELSE day END AS day),
        CASE WHEN (away_key + home_key * 2) % 5 = 0 THEN away_key ELSE home_key END AS k1,
        CASE WHEN (away_key + home_key * 2) % 5 = 0 THEN home_key ELSE away_key END AS k2
      FROM pairings WHERE (away_key + home_key + week) % 29 <> 0)
WHERE {season_of('day')} BETWEEN 1995 AND 2001 AND day BETWEEN {week_start(season_of('day'), 1)} AND {week_start(season_of('day'), 18)} + 7"""

PAIRED = [c for pair in fv.RATING_PAIRS for c in pair]
SWAPPED = [c for pair in fv.RATING_PAIRS for c in pair[::-1]]
CTE["rating_pairs"] = f"""
SELECT date, week, neutral, surface_factor, season, {cols(PAIRED)} FROM one_way
UNION ALL
SELECT date, week, neutral, surface_factor, season, {cols(f'{b} AS {a}' for a, b in zip(PAIRED, SWAPPED))} FROM one_way"""

PLACE = f"CASE WHEN key < {NAMED} THEN {pick(LABELS, 'key')} ELSE 'E' || key END"
CTE["ranking_values"] = f"""
SELECT season, week,
  {look(fv.PLACE_CODES, 'plain')} AS abbr, metric,
  {number('value')} AS value
FROM (
  SELECT season, week, metric, value,
    CASE WHEN m < 6 THEN regexp_replace(label, '\\s+\\(\\d+-\\d+(-\\d+)*\\)$', '') ELSE label END AS plain
  FROM (
    SELECT season, week, m, {pick(METRICS, 'm')} AS metric,
      CASE WHEN m < 6 THEN {PLACE} || ' (' || (total % 12) || '-' || (total % 5)
           || CASE WHEN total % 4 = 0 THEN '-1' ELSE '' END || ')' ELSE {PLACE} END AS label,
      CASE WHEN total % 11 = 0 THEN '--' WHEN total % 13 = 0 THEN 'NaN' WHEN total % 17 = 0 THEN '1.5d'
           WHEN total % 19 = 0 THEN 'Infinity' ELSE CAST(total / 4 AS VARCHAR) END AS value
    FROM (SELECT {step_of('l_shipdate')}, l_suppkey AS key, l_partkey % 14 AS m,
                 CAST(sum(l_quantity) AS BIGINT) AS total
          FROM lineitem WHERE l_shipdate {DATES} GROUP BY 1, 2, 3, 4)
    WHERE season < 2001 OR week <= 11))"""

CTE["inner_lists"] = """
SELECT page_id, [regexp_replace(x, '<[^>]*>', '', 'g') FOR x IN
  regexp_extract_all(regexp_extract(html, '(?is)<ul\\b[^>]*>(.*?)</ul\\s*>', 1), '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1)] AS labels
FROM pages WHERE html IS NOT NULL"""

CTE["wide_rankings"] = f"""
SELECT season, week, abbr, {cols(f"max(value) FILTER (metric = '{m}') AS {m}" for m in METRICS)}
FROM ranking_values GROUP BY 1, 2, 3"""

CTE["carried"] = f"""
SELECT season, week, abbr, {cols(METRICS)} FROM wide_rankings
UNION ALL
SELECT r.season, t.week, abbr, {cols(METRICS)} FROM wide_rankings r
JOIN steps t ON t.season = r.season AND t.week > 11 WHERE r.season = 2001 AND r.week = 11"""

CTE["filled_rankings"] = f"""
SELECT season, week, abbr, {cols(f'coalesce({m}, 0.0) AS {m}' for m in METRICS)} FROM carried"""

CTE["division_of"] = f"""
SELECT {code(fv.STANDARD_CODES, 's_suppkey')} AS abbr, 'D' || (s_nationkey % 8) AS division
FROM supplier WHERE s_nationkey < 20"""

SAME = "CAST(CASE WHEN ad.division IS NOT DISTINCT FROM hd.division THEN 1 ELSE 0 END AS INTEGER) AS division"

RENAMED = {a: b for a, b in fv.RATING_NAMES.items() if not a.startswith("team")}
CTE["combined"] = f"""
SELECT * REPLACE ({look(fv.MODERN_NAMES, 'away_name')} AS away_name, {look(fv.MODERN_NAMES, 'home_name')} AS home_name)
FROM (
  SELECT f.*, {cols(f'ra.{m} AS away_{m}, rh.{m} AS home_{m}' for m in METRICS)},
    e.date, e.neutral, e.surface_factor, {cols(f'e.{a} AS {b}' for a, b in RENAMED.items())},
    elo2_pre - elo1_pre AS elo_dif, qb2_value_pre - qb1_value_pre AS qb_dif,
    qbelo2_pre - qbelo1_pre AS qb_elo_dif,
    away_spread, away_moneyline, home_spread, home_moneyline, total_line, {SAME}
  FROM features f
  LEFT JOIN filled_rankings ra ON ra.season = f.season AND ra.week = f.week AND ra.abbr = f.away_abbr
  LEFT JOIN filled_rankings rh ON rh.season = f.season AND rh.week = f.week AND rh.abbr = f.home_abbr
  JOIN rating_pairs e ON e.season = f.season AND e.week = f.week AND e.team1 = f.home_abbr AND e.team2 = f.away_abbr
  LEFT JOIN contest_lines l ON l.season = f.season AND l.week = f.week AND l.away_abbr = f.away_abbr AND l.home_abbr = f.home_abbr
  LEFT JOIN division_of ad ON ad.abbr = f.away_abbr
  LEFT JOIN division_of hd ON hd.abbr = f.home_abbr)"""

DIFFS = [f"{s}_diff" for s in COMPARED]
SIDES = [f"{side}_{s}" for s in COMPARED for side in ("away", "home")]
FEATURE_KEYS = [
    "away_name", "away_abbr", "home_name", "home_abbr", "season", "week",
    "away_game_number", "home_game_number",
]
RANK_COLS = [f"{side}_{m}" for m in METRICS for side in ("away", "home")]
COMBINED = [
    *FEATURE_KEYS, "neutral", "division", "away_qb", "home_qb",
    *RANK_COLS, *fv.LINE_COLUMNS, *fv.RESULT_COLUMNS,
    "elo_dif", "qb_dif", "qb_elo_dif",
    *[c for c in fv.RATING_NAMES.values() if c.endswith("_pre")],
]
COMBINED_SQL = cols([*COMBINED, *[r6(c, c) for c in [*SIDES, *DIFFS]]])


def output_rows(where) -> str:
    return f"SELECT CAST(date AS TIMESTAMP) AS date, {COMBINED_SQL} FROM combined WHERE {where}"


# --- learning ----------------------------------------------------------------------
def k2_sql() -> str:
    y = "skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2)))"
    beta = "3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))"
    w2 = f"(sqrt(2 * ({beta} - 1)) - 1)"
    z1 = f"asinh({y} / sqrt(2 / ({w2} - 1))) / sqrt(0.5 * ln({w2}))"
    x = (
        "(excess + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) "
        "/ ((n + 1) * (n + 1) * (n + 3) * (n + 5)))"
    )
    rt = (
        "(6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) "
        "* sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))"
    )
    a = f"(6 + 8 / {rt} * (2 / {rt} + sqrt(1 + 4 / ({rt} * {rt}))))"
    z2 = (
        f"(1 - 2 / (9 * {a}) - cbrt((1 - 2 / {a}) / (1 + {x} * sqrt(2 / ({a} - 4))))) / sqrt(2 / (9 * {a}))"
    )
    return f"(({z1}) * ({z1}) + ({z2}) * ({z2}))"


def yj(x, lam: float) -> str:
    up = f"ln(1 + {x})" if lam == 0 else f"(pow({x} + 1, {lam}) - 1) / {lam}"
    down = f"-ln(1 - {x})" if lam == 2 else f"-(pow(1 - {x}, {2 - lam}) - 1) / {2 - lam}"
    return f"CASE WHEN {x} >= 0 THEN {up} WHEN {x} < 0 THEN {down} END"


ORDER_SCORES = """
SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS INTEGER) AS score,
       CAST(o_custkey % 37 + 10 AS DOUBLE) AS guess FROM orders"""
CTE["order_scores"] = ORDER_SCORES


def fitted_lambdas() -> str:
    """Grids of whole numbers, hundredths and so on over all lambdas from -400 to 400.

    Differences of the transform are taken from the mean logarithm, where all values have one
    sign, so that large lambdas keep their digits.
    """
    own = "CASE WHEN side < 0 THEN 2 - l ELSE l END"
    grown = f"CASE WHEN abs({own}) < 1e-12 THEN size - c ELSE exp(({own}) * (size - c)) / ({own}) END"
    down = "CASE WHEN abs(2 - l) < 1e-12 THEN -size ELSE -(exp((2 - l) * size) - 1) / (2 - l) END"
    up = "CASE WHEN abs(l) < 1e-12 THEN size ELSE (exp(l * size) - 1) / l END"
    moved = f"CASE WHEN side = 0 AND x >= 0 THEN {up} WHEN side = 0 THEN {down} ELSE {grown} END"
    chance = "((o_orderkey * 7919 % 99991 + 0.5) / 99991)"
    rounds = [
        f"""samples AS (
  SELECT 'price' AS feature, o_totalprice / 1000 AS x FROM orders
  UNION ALL SELECT 'log_price', ln(1 + o_totalprice) FROM orders
  UNION ALL SELECT 'signed', CAST(o_custkey % 97 - 40 AS DOUBLE) FROM orders
  UNION ALL SELECT 'far', 1500 - 40 * ln({chance}) FROM orders
  UNION ALL SELECT 'far_below', 40 * ln({chance}) - 1500 FROM orders)""",
        """sized AS (
  SELECT feature, x, size, side, CASE WHEN side = 0 THEN 0 ELSE avg(size) OVER (PARTITION BY feature) END AS c
  FROM (SELECT feature, x, ln(1 + abs(x)) AS size,
          CASE WHEN min(x) OVER w >= 0 THEN 1 WHEN max(x) OVER w <= 0 THEN -1 ELSE 0 END AS side
        FROM samples WINDOW w AS (PARTITION BY feature)))""",
        "best0 AS (SELECT DISTINCT feature, 0.0::DOUBLE AS lam FROM samples)",
    ]
    for i, (reach, step) in enumerate([(400, 1.0), (60, 0.05), (60, 0.002), (60, 0.0001)]):
        rounds.append(
            f"""best{i + 1} AS (
  SELECT feature, arg_max(l, fit) AS lam FROM (
    SELECT feature, l, n, CASE WHEN variance > 0 AND isfinite(variance) THEN -0.5 * n * ln(variance) + jacobian END AS fit
    FROM (SELECT feature, l, count(*) AS n, var_pop({moved}) AS variance,
            any_value(CASE WHEN side = 0 THEN l - 1 ELSE 0 END) * sum(sign(x) * size) AS jacobian
          FROM (SELECT s.*, lam + k * {step!r}::DOUBLE AS l
                FROM sized s JOIN best{i} b ON b.feature = s.feature, range(-{reach}, {reach} + 1) g(k)
                WHERE s.side <> 0 OR abs(lam + k * {step!r}::DOUBLE) < 50)
          GROUP BY feature, l)) WHERE isfinite(fit) GROUP BY feature)"""
        )
    return f"WITH {', '.join(rounds)} SELECT feature, round_even(lam * 1000, 0) / 1000 AS lam FROM best4"


# --- one statement per query ---------------------------------------------------------
BODY: dict[str, str] = {
    "team_games": "SELECT * FROM base_facts",
    "opponent_mirror": " UNION ALL ".join(
        f"SELECT boxscore_id, '{side}' AS side, {cols(f'{side}_{s} AS {s}' for s in MIRRORED)}, "
        f"{cols(f'{other}_{s} AS opponent_{s}' for s in MIRRORED)} FROM boxscores"
        for side, other in (("away", "home"), ("home", "away"))
    ),
    "game_numbers": "SELECT season, week, team_abbr, game_number FROM numbers",
    "schedule": "SELECT * FROM numbered",
    "win_pct_diff": f"""
SELECT g.season, g.week, g.away_abbr, g.home_abbr, {r6('a.win_perc', 'away_win_perc')},
       {r6('h.win_perc', 'home_win_perc')}, {r6('a.win_perc - h.win_perc', 'win_perc_diff')}
FROM coded_games g
LEFT JOIN raw_form a ON a.season = g.season AND a.week = g.week AND a.team_abbr = g.away_abbr
LEFT JOIN raw_form h ON h.season = g.season AND h.week = g.week AND h.team_abbr = g.home_abbr""",
    "facts": "SELECT * FROM facts",
    "placeholders": """
SELECT boxscore_id, season, week, away_score, home_score, away_total_yards, home_total_yards,
       away_time_of_possession, away_first_downs IS NULL AS is_placeholder FROM attached""",
    "possession_seconds": f"""
SELECT boxscore_id, away_clock, {clock('away_clock')} AS away_seconds, {clock('home_time_of_possession')} AS home_seconds
FROM (SELECT *, CASE boxscore_id[8:8] WHEN '3' THEN replace(away_time_of_possession, ':', '')
        WHEN '5' THEN 'x' || away_time_of_possession ELSE away_time_of_possession END AS away_clock FROM boxscores)""",
    "ratio_sums": f"SELECT season, team_name, team_abbr, {SUMS_SQL} FROM facts GROUP BY 1, 2, 3",
    "guarded_rates": f"""
SELECT season, team_name, team_abbr, {cols(r6(c, c) for c in RATE_NAMES)} FROM (
  SELECT *, {RATES_SQL} FROM (
    SELECT season, team_name, team_abbr, {SUMS_SQL} FROM facts GROUP BY 1, 2, 3))""",
    "stat_means": f"""
SELECT season, team_name, team_abbr, {cols(r6(f'avg({c})', c) for c in MEANS)}
FROM facts GROUP BY 1, 2, 3""",
    "expanding_form": f"""
SELECT season, week, team_name, team_abbr, {cols(fv.RATIO_INPUTS)}, {cols(r6(c, c) for c in FORM)}
FROM raw_form WHERE NOT from_prior""",
    "prior_season_fallback": f"""
SELECT r.season, r.week, team_name, r.team_abbr, {cols(fv.RATIO_INPUTS)}, {cols(r6(c, c) for c in FORM)},
       coalesce(n.game_number = 1, false) AS starting
FROM raw_form r LEFT JOIN coded_numbers n
  ON n.season = r.season AND n.week = r.week AND n.team_abbr = r.team_abbr
WHERE from_prior""",
    "refreshed_form": f"""
SELECT season, week, team_name, team_abbr, from_prior, {cols(fv.RATIO_INPUTS)}, {cols(r6(c, c) for c in FORM)}
FROM raw_form""",
    "missing_entities": """
SELECT t.season, s.team_abbr, t.week
FROM (SELECT DISTINCT season, team_abbr FROM numbers) s JOIN steps t ON t.season = s.season AND t.week > 1
WHERE s.team_abbr NOT IN (
  SELECT away_abbr FROM games g WHERE away_score IS NOT NULL AND g.season = t.season AND g.week < t.week
  UNION ALL
  SELECT home_abbr FROM games g WHERE away_score IS NOT NULL AND g.season = t.season AND g.week < t.week)""",
    "league_mean": f"""
SELECT season, week, {cols(r6(f'league_{s}', f'league_{s}') for s in FORM)} FROM league""",
    "shrunk_form": f"""
SELECT season, week, team_name, team_abbr, from_prior, {cols(fv.RATIO_INPUTS)}, {cols(r6(c, c) for c in FORM)}
FROM form""",
    "contest_features": f"""
SELECT {cols(FEATURE_KEYS)}, {cols(r6(c, c) for c in [*SIDES, *DIFFS])}, {cols(fv.RESULT_COLUMNS)}
FROM features""",
    "colocated_features": f"""
SELECT {cols(f"f.{k}" for k in FEATURE_KEYS)}, {cols(r6(f"f.{c}", c) for c in [*SIDES, *DIFFS])}, {cols(f"f.{c}" for c in fv.RESULT_COLUMNS)},
  {cols(f'{r6(f"ra.{m}", f"away_{m}")}, {r6(f"rh.{m}", f"home_{m}")}' for m in METRICS)}
FROM features f
LEFT JOIN filled_rankings ra ON ra.season = f.season AND ra.week = f.week AND ra.abbr = f.away_abbr
LEFT JOIN filled_rankings rh ON rh.season = f.season AND rh.week = f.week AND rh.abbr = f.home_abbr""",
    "footer_counts": """
SELECT UNNEST(['l_orderkey', 'quantity', 'flag', 'tax']) AS "column",
  UNNEST([n, quantity, flag, tax]) AS n_values, UNNEST([n > 0, quantity > 0, flag > 0, tax > 0]) AS kept
FROM (SELECT count(*) AS n, count(l_quantity) FILTER (l_orderkey % 3 > 0) AS quantity,
  count(l_returnflag) FILTER (l_orderkey % 7 = 0) AS flag, count(l_tax) FILTER (l_orderkey < 0) AS tax FROM lineitem)""",
    "season_start": f"""
SELECT year, orders, {season_start('year')} AS season_start, {anchor('year')} AS week_one
FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders FROM orders GROUP BY 1)""",
    "week_of_date": f"""
SELECT day, items, CAST({week_of('day')} AS INTEGER) AS week
FROM (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS items FROM lineitem GROUP BY 1)""",
    "season_of_date": f"""
SELECT CAST({season_of('day')} AS INTEGER) AS season, count(*) AS items, min(day) AS first_day, max(day) AS last_day
FROM (SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem) GROUP BY 1""",
    "calendar": f"""
SELECT season, week, {week_start('season', 'week')} AS week_start
FROM (SELECT season, CAST(unnest(range(1, CASE WHEN season < 2021 THEN 18 WHEN season <= 2023 THEN 19 ELSE 1 END)) AS INTEGER) AS week
  FROM (SELECT DISTINCT CAST(y - k AS INTEGER) AS season FROM (
    SELECT year(o_orderdate) AS y FROM orders UNION SELECT year(ts) FROM events), range(0, 2) r(k)))""",
    "season_membership": """
SELECT o_orderkey, contest_id, season,
  CAST(TRY_STRPTIME(left(contest_id, 8), '%Y%m%d') AS DATE) AS id_date,
  CASE WHEN length(contest_id) < 8 OR y IS NULL OR m IS NULL THEN false
       WHEN y = season + 1 AND m = 1 THEN false
       WHEN y = season AND m < 8 THEN true
       WHEN y <> season THEN true
       ELSE false END AS other_season
FROM (SELECT *, TRY_CAST(contest_id[1:4] AS INTEGER) AS y, TRY_CAST(contest_id[5:6] AS INTEGER) AS m FROM (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y%m')
         WHEN o_orderkey % 13 = 0 THEN '19x5' || strftime(o_orderdate, '%m%d') || 'x' || o_orderkey
         ELSE strftime(o_orderdate, '%Y%m%d') || 'x' || o_orderkey END AS contest_id,
    CAST(year(o_orderdate) - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END
         + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS INTEGER) AS season
  FROM orders))""",
    "line_validity": f"""
SELECT count(*) AS rows_seen, count(*) FILTER (NOT ok) AS rejected,
  count(*) FILTER (ok AND spread_source = 'default') AS default_spreads,
  count(*) FILTER (ok AND total_line_source = 'default') AS default_totals,
  {cols(f'count(*) FILTER (ok AND ({quoted(s)}) IS NULL) AS computed_{s}_moneylines' for s in ('home', 'away'))}
FROM chosen_quotes""",
    "line_choice": """
SELECT o_orderkey, home_spread, away_spread, spread_source, total_line, total_line_source
FROM chosen_quotes WHERE ok""",
    "moneyline_source": """
SELECT o_orderkey, spread_source, total_line_source, moneyline_source FROM chosen_quotes WHERE ok""",
    "moneyline": "SELECT o_orderkey, moneyline_source, home_moneyline, away_moneyline FROM priced_quotes",
    "season_lines": final_lines("priced_quotes"),
    "lines_of_season": final_lines("priced_quotes") + " WHERE season = 2000",
    "standard_codes": f"""
SELECT o_orderkey, code,
  {look(STD, 'code')} AS exact_or_kept,
  {look(ANY, 'trim(code)')} AS any_or_kept,
  {look(dict(zip(fv.RATING_CODES, fv.STANDARD_CODES)), 'code', keep=False)} AS known_or_null
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 23 <> 0 THEN
    CASE WHEN o_custkey % 4 = 0 THEN ' ' || c || ' ' ELSE c END END AS code
  FROM (SELECT o_orderkey, o_custkey, {pick(CODE_POOL, f'(o_orderkey % {len(CODE_POOL)})')} AS c FROM orders))""",
    "rating_pairs": "SELECT * FROM rating_pairs",
    "metric_pivot": "SELECT * FROM wide_rankings",
    "metric_full_join": f"""
SELECT season, week, abbr, {cols(METRICS)} FROM wide_rankings""",
    "carry_forward": "SELECT * FROM carried",
    "last_known": f"""
SELECT season, week, abbr, {cols(f'last_value({m} IGNORE NULLS) OVER w AS {m}' for m in METRICS)}
FROM wide_rankings
WINDOW w AS (PARTITION BY season, abbr ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "html_items": """
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, label, """ + number("label") + """ AS value
FROM (SELECT page_id, pos, trim(regexp_replace(items[pos], '<[^>]*>', '', 'g')) AS label
  FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS pos
    FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?is)<ul\\b[^>]*>(.*?)</ul\\s*>', 1),
                                             '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1) AS items FROM pages)))""",
    # Expected items follow from how the list is put together: the inner ones and three more.
    "nested_items": """
SELECT page_id, CAST(pos AS INTEGER) AS pos, label, """ + number("label") + """ AS value
FROM (
  SELECT page_id, 0 AS pos, '0.5' AS label FROM inner_lists
  UNION ALL SELECT page_id, 1, 'all: ' || array_to_string(labels, '') FROM inner_lists
  UNION ALL SELECT page_id, 1 + k, trim(labels[k]) FROM inner_lists, unnest(range(1, len(labels) + 1)) r(k)
  UNION ALL SELECT page_id, 2 + len(labels), 'last' FROM inner_lists)""",
    "rankings": "SELECT * FROM filled_rankings",
    "division_games": f"""
SELECT g.season, g.week, g.away_abbr, g.home_abbr, {SAME} FROM coded_games g
LEFT JOIN division_of ad ON ad.abbr = g.away_abbr LEFT JOIN division_of hd ON hd.abbr = g.home_abbr""",
    "combined": f"SELECT date, surface_factor, {COMBINED_SQL} FROM combined",
    "all_data": f"SELECT CAST(date AS TIMESTAMP) AS date, {COMBINED_SQL} FROM combined",
    "feature_table": f"""
SELECT season, count(*) AS contests, count(result) AS with_result, CAST(sum(division) AS BIGINT) AS division_games,
  {r6('avg(points_scored_diff)', 'mean_points_diff')},
  {len(COMBINED) + len(SIDES) + len(DIFFS) + 1} AS columns FROM combined GROUP BY 1""",
    "completed": output_rows("result IS NOT NULL"),
    "to_predict": output_rows("season = 2001 AND week = 11 AND result IS NULL"),
    "outputs": """
SELECT output, season, week, count(*) AS contests FROM (
  SELECT season, week, CASE WHEN result IS NOT NULL THEN 'completed'
    WHEN season = 2001 AND week = 11 THEN 'to_predict' END AS output FROM combined)
WHERE output IS NOT NULL GROUP BY 1, 2, 3""",
    "nested_flatten": """
SELECT event_id, event_type || '/' || key AS path, CAST(json_extract(props, '$.' || key) AS INTEGER) AS leaf
FROM (SELECT event_id, event_type, props, unnest(json_keys(props)) AS key FROM events)""",
    "variant_flatten": """
WITH docs AS (
  SELECT event_id, event_type, (event_id % 4)::INT AS depth,
    array_to_string([printf('level%d/0/', (event_id % 4)::INT - k) FOR k IN range((event_id % 4)::INT)], '') AS above, props FROM events
), parts AS (  -- what each level adds around the one below
  SELECT event_id, event_type, unnest(range(1, depth + 1)) AS level, depth FROM docs
), around AS (
  SELECT event_id, event_type, level,
    array_to_string([printf('level%d/0/', (depth - k)::INT) FOR k IN range(depth - level)], '') AS above FROM parts
)
SELECT event_id, above || key AS path, json_extract_string(props, '$.' || key) AS leaf
FROM (SELECT *, unnest(json_keys(props)) AS key FROM docs)
UNION ALL SELECT event_id, above || 'level' || level || '/1', '7' FROM around
UNION ALL SELECT event_id, above || 'none', NULL FROM around
UNION ALL SELECT event_id, above || 'by', event_type FROM around""",
    "nested_table": """
SELECT event_id, event_type AS path, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, value FROM events""",
    "prediction_lines": """
SELECT boxscore_id, printf('Season: %d %-7s: %-21s (%-8s at %-21s (%-8s', season, 'Week ' || week, away_name,
    CAST(round_even(p * 100, 2) AS VARCHAR) || '%)', home_name,
    CAST(round_even((1.0 - p) * 100, 2) AS VARCHAR) || '%)') AS line
FROM (SELECT *, ((season * 7 + week * 31 + length(away_abbr) * 13) % 1000) / 1000 AS p FROM games)""",
    "normality": f"""
SELECT feature, size AS n, round(skew, 6) AS skew, round(excess, 6) AS excess, round(k2, 2) AS k2,
       round(exp(-k2 / 2), 6) AS p_value, exp(-k2 / 2) > 0.05 AS is_normal
FROM (SELECT *, {k2_sql()} AS k2 FROM (
  SELECT feature, count(x) AS size, CAST(count(x) AS DOUBLE) AS n,
    avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) AS skew,
    avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3 AS excess
  FROM (SELECT feature, x, avg(x) OVER (PARTITION BY feature) AS m FROM (
    {' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS x FROM lineitem" for c in LINE_ITEM_FEATURES)}))
  GROUP BY feature))""",
    "zscore": f"""
SELECT l_orderkey, l_linenumber, l_partkey, {cols(r6(c, c) for c in LINE_ITEM_FEATURES)},
  {cols(r6(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', f'{c}_z') for c in LINE_ITEM_FEATURES)}
FROM lineitem""",
    "yeo_johnson": f"""
SELECT c_custkey, {cols(r6(yj('x', lam), name) for name, lam in (('half', 0.5), ('log_up', 0.0), ('log_down', 2.0), ('third', -1.5)))}
FROM (SELECT c_custkey, c_acctbal / 777 AS x FROM customer)""",
    "yeo_johnson_fitted": fitted_lambdas(),
    "holdout_split": f"""
SELECT o_orderkey, {bucket(mixed('o_orderkey'), 1000)} < 300 AS held_out FROM orders""",
    "folds": f"""
SELECT o_orderkey, score, guess,
  CAST((row_number() OVER (PARTITION BY score ORDER BY {mixed('o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM order_scores""",
    "holdout_error": f"""
SELECT 'score' AS target, count(*) AS n, {r6('avg(abs(score - guess))', 'mae')},
  {r6('sqrt(avg(abs(score - guess)))', 'root_mae')}, {r6('sqrt(avg(pow(score - guess, 2)))', 'rmse')}
FROM order_scores WHERE {bucket(mixed('o_orderkey'), 1000)} < 300""",
}


KEY = "CAST('0x' || md5(season || '|' || week || '|' || away_abbr || '|' || home_abbr)[1:15] AS BIGINT)"
SCALED = [
    *SIDES, *DIFFS, *RANK_COLS, *fv.LINE_COLUMNS, "elo_dif", "qb_dif", "qb_elo_dif",
    *[c for c in fv.RATING_NAMES.values() if c.endswith("_pre")],
]
BODY["scaled_features"] = f"""
SELECT feature, n, 0.0::DOUBLE AS mean, CASE WHEN n = 0 THEN NULL WHEN low = high THEN 0.0 ELSE 1.0 END::DOUBLE AS spread,
  coalesce(low = high, false) AS constant
FROM (SELECT feature, count(x) AS n, min(x) AS low, max(x) AS high FROM (
      SELECT {cols(f'{c}::DOUBLE AS {c}' for c in SCALED)}, 1523.7::DOUBLE AS constant,
        (({KEY} % 99991) + 0.5) / 99991 * 1e-14 AS narrow, 1500 - 40 * ln((({KEY} % 99991) + 0.5) / 99991) AS far
      FROM combined WHERE result IS NOT NULL)
    UNPIVOT INCLUDE NULLS (x FOR feature IN ({cols([*SCALED, 'constant', 'narrow', 'far'])})) GROUP BY feature)"""
BODY["search_settings"] = """
SELECT CAST(o_orderkey % 100 AS INTEGER) AS draw, count(*) AS orders, true AS inside, 7 AS settings
FROM orders GROUP BY 1"""
BODY["score_predictions"] = """
SELECT season, week, away_abbr, home_abbr, true AS away_in_range, true AS away_rounded, true AS home_in_range,
  true AS home_rounded
FROM combined WHERE season = 2001 AND week = 11 AND result IS NULL"""
HELD = f"result IS NOT NULL AND {bucket(mixed(KEY), 1000)} < 300"
BODY["train_and_score"] = " UNION ALL ".join(
    f"""
SELECT '{t}' AS target, count({t}) AS n, {r6(f'stddev_pop(CAST({t} AS INTEGER))', 'deviation')}, true AS sane, true AS ordered
FROM combined WHERE {HELD}"""
    for t in ("away_score", "home_score")
)
BODY["kept_model"] = f"""
SELECT count(*) AS orders, count(*) FILTER (held) AS held_out,
  {r6('stddev_pop(thousands) FILTER (held)', 'deviation')}, true AS learned, 0::BIGINT AS changed_by_reload,
  true AS trials_recorded
FROM (SELECT sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // 100000 AS thousands, {bucket(mixed('l_orderkey'), 1000)} < 300 AS held
  FROM lineitem GROUP BY l_orderkey)"""
BODY["stored_version"] = "SELECT * REPLACE (value * 2 AS value) FROM events"
BODY["stored_partitions"] = """
SELECT season, week, pass, count(*) AS orders FROM (
  SELECT season, week, CAST(CASE WHEN season = 1997 AND week <= 6 THEN 2 WHEN season = 1996 AND week = 2 THEN 2 ELSE 1 END AS INTEGER) AS pass
  FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week FROM orders)
  WHERE NOT (season = 1997 AND week = 3)) GROUP BY 1, 2, 3"""
BODY["csv_round_trip"] = "SELECT * FROM customer"
BODY["csv_unnamed"] = "SELECT * FROM customer"
BODY["record_lists"] = """
SELECT l_orderkey, l_linenumber::INTEGER AS line, CASE WHEN l_linenumber % 4 > 0 THEN l_quantity::DOUBLE END AS quantity,
  l_returnflag AS flag, NULL::VARCHAR AS absent FROM lineitem"""
BODY["stamped_dates"] = """
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 11 = 0 THEN 'unknown'
  WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y-') || '13-45' WHEN o_orderkey % 17 = 0 THEN ''
  WHEN o_orderkey % 19 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) AS date FROM orders"""
BODY["observed_line_quality"] = BODY["line_validity"]
BODY["lines_from_csv"] = BODY["season_lines"]
BODY["csv_declared"] = "SELECT * FROM supplier"
BODY["missing_values"] = "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance FROM customer"


def with_tables(body: str) -> str:
    """Prefix a statement with the shared tables it needs, in order of use."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        words = set(re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "", sql)))
        for name in CTE:
            if name in words and name not in needed and sql is not CTE[name]:
                visit(CTE[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    tables = ",\n".join(f"{name} AS MATERIALIZED ({CTE[name]})" for name in needed)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {tables},\n{body.lstrip()[5:]}"
    return f"WITH {tables}\n{body}"


def sql_by_query() -> dict[str, str]:
    return {name: with_tables(body) for name, body in BODY.items()}
