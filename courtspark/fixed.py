"""Fixed values that results depend on: patterns, lists, lookup tables, thresholds."""

from __future__ import annotations

# --- fixed values: results and box scores -------------------------------------------------
RESULT_PATTERN = r"^([WL])\s+(\d+)-(\d+)(?:\s+\((\d*OT)\))?$"
DOUBLE_STATS = ("PTS", "TRB", "AST", "STL", "BLK")
REQUIRED_GAMES = ("Player", "Date", "Team", "Opp", "Result", "MP",
                  "PTS", "TRB", "AST", "STL", "BLK", "TOV")
REQUIRED_TEAMS = ("Team", "Date", "Result", "MP", "PTS", "PTS_Opp")
REQUIRED_BIOMETRICS = ("Player", "Height", "Weight")

# --- fixed values: situation factors ------------------------------------------------------
# target -> value for 0 days, 1 day, 2 days, 3 or more days of rest
REST_ENERGY = {
    "win": (0.85, 0.92, 1.0, 1.08),
    "points": (0.92, 0.97, 1.0, 1.03),
    "total": (0.92, 0.97, 1.0, 1.03),
    "double": (0.80, 0.90, 1.0, 1.10),
}
REST_ADVANTAGE = {
    "win": (-0.15, -0.05, 0.0, 0.08),
    "points": (-3.5, -1.2, 0.0, 2.2),
    "total": (-3.0, -1.0, 0.0, 2.0),
    "double": (-0.20, -0.08, 0.0, 0.12),
}
HOME_ADVANTAGE = {"win": 0.06, "double": 0.03}
TRAVEL_PENALTY = {"win": -0.02, "double": -0.01}
ROAD_B2B_PENALTY = -0.04
HOME_COURT_BOOST = {"points": 2.8, "total": 2.5}
STARTER_BOOST = 0.15
WEEKEND_BOOST = {"win": 0.01, "double": 0.02}
SEASON_IMPORTANCE = {"points": (1.06, 1.03, 1.0), "total": (1.05, 1.02, 1.0)}  # >200, >100 days
URGENCY_LATE_SEASON = 1.04
SEASON_GAMES = 82
ALTITUDE_TEAMS = ("DEN", "UTA", "PHX")
ALTITUDE_FACTOR = {"win": (0.025, 0.0), "points": (1.02, 1.0), "total": (1.02, 1.0)}
RIVALS_DIRECTED = {
    "LAL": ("BOS", "LAC"),
    "BOS": ("LAL", "PHI"),
    "GSW": ("LAC", "CLE"),
    "MIA": ("BOS", "NYK"),
    "CHI": ("DET", "CLE"),
    "DAL": ("SAS", "HOU"),
}
RIVALS_UNDIRECTED = (("ATL", "BOS"), ("ATL", "GSW"), ("BOS", "PHI"),
                     ("MIA", "BOS"), ("LAC", "ATL"), ("GSW", "LAC"))
RIVAL_FACTOR_DIRECTED = 1.04
RIVAL_FACTOR_UNDIRECTED = 1.03

# --- fixed values: fills and ranges -------------------------------------------------------
SHOOTING_FILL = {"FG%": 0.45, "3P%": 0.35, "FT%": 0.75}
NAME_FILL_PERCENT, NAME_FILL_POINTS, NAME_FILL_PACE = 0.45, 110.0, 100.0
TEAM_POINTS_RANGE = (70.0, 160.0)
TOTAL_POINTS_RANGE = (150.0, 350.0)
TEAM_PROJECTION_CLIP = (85.0, 150.0)
TOTAL_PROJECTION_CLIP = (185.0, 275.0)
TOTAL_PREDICTION_CLIP = (200.0, 250.0)
TOTAL_PREDICTION_DEFAULT = 220.0
SCORING_TIERS = (("low_scoring", 0.0, 95.0), ("mid_scoring", 95.0, 115.0),
                 ("high_scoring", 115.0, 200.0))
TIER_FACTOR = {"low_scoring": 0.98, "mid_scoring": 1.0, "high_scoring": 1.02}

# --- fixed values: markets ----------------------------------------------------------------
TARGET_LINES = {
    "PTS": (10, 15, 20, 25, 30, 35),
    "TRB": (4, 6, 8, 10, 12),
    "AST": (4, 6, 8, 10, 12),
    "3P": (1, 2, 3, 4, 5),
}
RECENT_WINDOWS = (3, 5, 10, 20)
PROP_SYNONYMS = {
    "PTS": ("points", "pts", "player points", "total points"),
    "TRB": ("rebounds", "reb", "player rebounds", "total rebounds", "trb"),
    "AST": ("assists", "ast", "player assists", "total assists"),
    "3P": ("threes", "3pt", "three pointers", "3 pointers", "3p"),
}

# --- fixed values: the 25 team codes of the test views, in nation-key order ---------------
VIEW_TEAMS = ("ATL", "BOS", "BKN", "CHA", "CHI", "CLE", "DAL", "DEN", "DET", "GSW",
              "HOU", "IND", "LAC", "LAL", "MEM", "MIA", "MIL", "MIN", "NYK", "ORL",
              "PHI", "PHX", "SAS", "TOR", "UTA")
