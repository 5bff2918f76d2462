"""Names, codes and constants that results depend on.

Everything in this module is a FIXED VALUE: list members, their order and the
numbers must stay as they are for results to agree with other users of the same
data. No logic lives here.
"""

# --- constants -------------------------------------------------------------
SEASON_END_MONTH = 2
FIRST_SEASON_WITH_18_WEEKS = 2021
WEEKS_BEFORE_2021 = 17
WEEKS_FROM_2021 = 18
LAST_WEEK = 18

DEFAULT_THIRD_DOWN = 0.4
DEFAULT_FOURTH_DOWN = 0.5
DEFAULT_WIN = 0.5
SHRINK_TO_LEAGUE = 1.0 / 3.0

MARGIN_STD_DEV = 14.21377923
BOOK_MARGIN = 0.05
MAX_PLAUSIBLE_PRICE = 400
DEFAULT_SPREAD = 0.0
DEFAULT_TOTAL = 44.0

RECORD_SUFFIX = r"\s+\(\d+-\d+(-\d+)*\)$"

# --- team codes ------------------------------------------------------------
# Standard codes and, position by position, the two other spellings in use.
STANDARD_CODES = [
    "ARI", "ATL", "BAL", "BUF", "CAR", "CHI", "CIN", "CLE", "DAL", "DEN", "DET",
    "GB", "HOU", "IND", "JAX", "KC", "LAC", "LAR", "LV", "MIA", "MIN", "NE",
    "NO", "NYG", "NYJ", "PHI", "PIT", "SEA", "SF", "TB", "TEN", "WSH", "WSH",
]
BOXSCORE_CODES = [
    "crd", "atl", "rav", "buf", "car", "chi", "cin", "cle", "dal", "den", "det",
    "gnb", "htx", "clt", "jax", "kan", "sdg", "ram", "rai", "mia", "min", "nwe",
    "nor", "nyg", "nyj", "phi", "pit", "sea", "sfo", "tam", "oti", "was", "was",
]
RATING_CODES = [
    "ARI", "ATL", "BAL", "BUF", "CAR", "CHI", "CIN", "CLE", "DAL", "DEN", "DET",
    "GB", "HOU", "IND", "JAX", "KC", "LAC", "LAR", "OAK", "MIA", "MIN", "NE",
    "NO", "NYG", "NYJ", "PHI", "PIT", "SEA", "SF", "TB", "TEN", "WAS", "WSH",
]
CODE_ALIASES = {
    "LV": "LV", "LVR": "LV", "OAK": "LV",
    "LA": "LAR", "STL": "LAR", "RAM": "LAR",
    "SD": "LAC", "SDG": "LAC",
    "WAS": "WSH", "WSH": "WSH",
    "GNB": "GB", "KAN": "KC", "NWE": "NE", "NOR": "NO", "TAM": "TB", "SFO": "SF",
    "OTI": "TEN", "JAC": "JAX", "CLT": "IND", "HTX": "HOU", "RAI": "LV",
}

# --- names -----------------------------------------------------------------
PLACE_CODES = {
    "Arizona": "ARI", "Atlanta": "ATL", "Baltimore": "BAL", "Buffalo": "BUF",
    "Carolina": "CAR", "Chicago": "CHI", "Cincinnati": "CIN", "Cleveland": "CLE",
    "Dallas": "DAL", "Denver": "DEN", "Detroit": "DET", "Green Bay": "GB",
    "Houston": "HOU", "Indianapolis": "IND", "Jacksonville": "JAX",
    "Kansas City": "KC", "LA Chargers": "LAC", "LA Rams": "LAR",
    "Las Vegas": "LV", "Miami": "MIA", "Minnesota": "MIN", "New England": "NE",
    "New Orleans": "NO", "NY Giants": "NYG", "NY Jets": "NYJ",
    "Philadelphia": "PHI", "Pittsburgh": "PIT", "San Francisco": "SF",
    "Seattle": "SEA", "Tampa Bay": "TB", "Tennessee": "TEN", "Washington": "WSH",
}
MODERN_NAMES = {
    "Oakland Raiders": "Las Vegas Raiders",
    "San Diego Chargers": "Los Angeles Chargers",
    "St. Louis Rams": "Los Angeles Rams",
    "Washington Football Team": "Washington Commanders",
    "Washington Redskins": "Washington Commanders",
}
# "WAS" as listed by the source; it is standardised to "WSH" before use.
DIVISIONS = {
    "AFC East": ["BUF", "MIA", "NE", "NYJ"],
    "AFC North": ["BAL", "CIN", "CLE", "PIT"],
    "AFC South": ["HOU", "IND", "JAX", "TEN"],
    "AFC West": ["DEN", "KC", "LV", "LAC"],
    "NFC East": ["DAL", "NYG", "PHI", "WAS"],
    "NFC North": ["CHI", "DET", "GB", "MIN"],
    "NFC South": ["ATL", "CAR", "NO", "TB"],
    "NFC West": ["ARI", "LAR", "SF", "SEA"],
}

# --- statistics ------------------------------------------------------------
BOXSCORE_STATS = [
    "first_downs", "rush_attempts", "rush_yards", "rush_touchdowns",
    "pass_completions", "pass_attempts", "pass_yards", "pass_touchdowns",
    "interceptions", "times_sacked", "yards_lost_from_sacks", "net_pass_yards",
    "total_yards", "fumbles", "fumbles_lost", "turnovers", "penalties",
    "yards_from_penalties", "third_down_conversions", "third_down_attempts",
    "fourth_down_conversions", "fourth_down_attempts", "time_of_possession",
]
FORM_STATS = [
    "win_perc", "points_scored", "points_allowed", "first_downs", "rush_attempts",
    "rush_yards", "rush_touchdowns", "pass_completions", "pass_attempts",
    "pass_yards", "pass_touchdowns", "interceptions", "times_sacked",
    "yards_lost_from_sacks", "net_pass_yards", "total_yards", "fumbles",
    "fumbles_lost", "turnovers", "penalties", "yards_from_penalties",
    "third_down_perc", "fourth_down_perc", "time_of_possession",
]
NO_OPPONENT_FORM = ["win_perc", "points_scored", "points_allowed", "time_of_possession"]
RATIO_INPUTS = [
    "game_won", "game_lost",
    "third_down_conversions", "third_down_attempts",
    "fourth_down_conversions", "fourth_down_attempts",
    "opponent_third_down_conversions", "opponent_third_down_attempts",
    "opponent_fourth_down_conversions", "opponent_fourth_down_attempts",
]
RANKING_RATINGS = [
    "predictive_rating", "home_rating", "away_rating", "strength_of_schedule_rating",
    "future_sos_rating", "last_5_games_rating",
]
RANKING_STATS = [
    "average_scoring_margin", "yards_per_point_margin", "points_per_play_margin",
    "turnover_margin_per_game", "penalty_yards_per_game",
    "opponent_penalty_yards_per_game", "penalty_yards_per_penalty",
    "opponent_penalty_yards_per_penalty",
]

# --- column lists ----------------------------------------------------------
RATING_DROPS = [
    "season", "playoff", "elo_prob1", "elo_prob2", "elo1_post", "elo2_post",
    "qb1_adj", "qb2_adj", "qbelo_prob1", "qbelo_prob2", "qb1_game_value",
    "qb2_game_value", "qb1_value_post", "qb2_value_post", "qbelo1_post",
    "qbelo2_post", "score1", "score2", "quality", "importance", "total_rating",
    "game_type", "game_id",
]
RATING_PAIRS = [
    ("team1", "team2"), ("qb1", "qb2"), ("elo1_pre", "elo2_pre"),
    ("qbelo1_pre", "qbelo2_pre"), ("qb1_value_pre", "qb2_value_pre"),
]
RATING_NAMES = {
    "team1": "home_name", "team2": "away_name", "qb1": "home_qb", "qb2": "away_qb",
    "elo1_pre": "home_elo_pre", "elo2_pre": "away_elo_pre",
    "qbelo1_pre": "home_qb_elo_pre", "qbelo2_pre": "away_qb_elo_pre",
    "qb1_value_pre": "home_qb_value_pre", "qb2_value_pre": "away_qb_value_pre",
}
LINE_DROPS = [
    "Unnamed: 0", "game_id", "home_spread_open_source", "home_spread_open_timestamp",
    "home_spread_last_source", "home_spread_last_timestamp", "home_spread_tickets_pct",
    "home_spread_money_pct", "home_spread_pcts_source", "home_spread_pct_timestamp",
    "ml_open_source", "ml_open_timestamp", "ml_last_source", "ml_last_timestamp",
    "total_line_open_source", "total_line_open_timestamp", "total_line_last_source",
    "total_line_last_timestamp",
]
LINE_LAYOUT = [
    "away_abbr", "home_abbr", "season", "week", "away_spread", "home_spread",
    "away_moneyline", "home_moneyline", "total_line",
]
FIRST_COLUMNS = [
    "away_name", "away_abbr", "home_name", "home_abbr", "away_qb", "home_qb", "season",
    "week", "date", "away_game_number", "home_game_number", "neutral", "division",
]
LINE_COLUMNS = ["away_spread", "away_moneyline", "home_spread", "home_moneyline", "total_line"]
RESULT_COLUMNS = ["away_score", "home_score", "result"]
