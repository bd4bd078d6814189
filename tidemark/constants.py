"""Fixed values shared by every module.

These must equal the values existing users plan with, so they are written out
plainly rather than derived.
"""

from __future__ import annotations

# ---- Frequencies (fixed values) -------------------------------------------
DAILY, WEEKLY, MONTHLY, QUARTERLY = "daily", "weekly", "monthly", "quarterly"
FREQUENCIES = (DAILY, WEEKLY, MONTHLY, QUARTERLY)

SEASON = {DAILY: 7, WEEKLY: 52, MONTHLY: 12, QUARTERLY: 4}
SEASON_CANDIDATES = {
    DAILY: (7, 14, 30, 91, 365),
    WEEKLY: (4, 13, 26, 52),
    MONTHLY: (3, 4, 6, 12),
    QUARTERLY: (4,),
}
DAYS_PER_PERIOD = {DAILY: 1.0, WEEKLY: 7.0, MONTHLY: 30.44, QUARTERLY: 91.31}
PERIODS_PER_YEAR = {DAILY: 365, WEEKLY: 52, MONTHLY: 12, QUARTERLY: 4}
MIN_OBSERVATIONS = {DAILY: 14, WEEKLY: 12, MONTHLY: 8, QUARTERLY: 6}
DEFAULT_HORIZON = {DAILY: 30, WEEKLY: 13, MONTHLY: 6, QUARTERLY: 4}
GAP_BANDS = {DAILY: (1, 1), WEEKLY: (6, 8), MONTHLY: (27, 32), QUARTERLY: (88, 93)}
MIN_GRID_COVERAGE = 0.3
MIN_GAP_AGREEMENT = 0.5
PERIOD_WORDS = {
    DAILY: ("day", "days"),
    WEEKLY: ("week", "weeks"),
    MONTHLY: ("month", "months"),
    QUARTERLY: ("quarter", "quarters"),
}

# ---- Keys and labels (fixed values) ---------------------------------------
SERIES_ID, DS, Y = "series_id", "ds", "y"
KEY_SEPARATOR = " · "
SINGLE_SERIES = "total"
MISSING_KEY = "(none)"
POOLED_KEY = "(others)"
POOLED_LABEL = "Others"
TOP_LINE = "Total"
MAX_SERIES = 500
MAX_SEGMENTS = 12

# ---- Admission (fixed values) ---------------------------------------------
SERIES_INLINE = 500
SERIES_HARD_LIMIT = 20_000

# ---- Quality and validation (fixed values) --------------------------------
INTERMITTENT_SHARE = 0.30
OUTLIER_SIGMAS = 3.5
MAD_TO_SIGMA = 1.4826
LOW_COVERAGE = 0.90
SEVERE_COVERAGE = 0.60
PARTIAL_RATIO = 0.35
MIN_PERIODS = 2
RUN_WINSORISE_SIGMAS = 6.0

# ---- Diagnostics (fixed values) -------------------------------------------
SIGNIFICANCE = 0.05
SURROGATE_DRAWS = 40
SURROGATE_MARGIN = 1.05
ADI_CUT = 1.32
CV2_CUT = 0.49
BOX_COX_GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
LOG_CEILING = 0.30
SEASONAL_DIFFERENCE_FLOOR = 0.64
CHANGEPOINT_SIGMAS = 2.2
CHANGEPOINT_HISTORY = 16
RECENT_CHANGEPOINT_SHARE = 0.25

# ---- Backtest and selection (fixed values) --------------------------------
MAX_FOLDS = 5
FOLD_CEILING = 12
ROLLING_SEASONS = 8
MIN_FOLD_SHARE = 0.5
DIVERGENCE_SIGMAS = 12.0
METRIC_WEIGHTS = {"wmape": 0.50, "mase": 0.30, "rmse": 0.20}
INTERMITTENT_WEIGHTS = {"mae": 0.50, "rmse": 0.50}
FORBIDDEN_METRICS = ("mape", "smape", "wmape_symmetric")
INTERVAL_WEIGHT = 0.15
COMPLEXITY_PENALTY = {
    "naive": 0.00,
    "seasonal_naive": 0.01,
    "theta": 0.015,
    "croston": 0.015,
    "holt_winters": 0.02,
    "ets": 0.02,
    "ensemble": 0.025,
    "sarimax": 0.03,
    "prophet": 0.035,
    "gradient_boosting": 0.04,
}
PARAMETER_BUDGET = {
    "naive": 1,
    "seasonal_naive": 2,
    "theta": 3,
    "croston": 2,
    "holt_winters": 6,
    "ets": 7,
    "ensemble": 10,
    "sarimax": 8,
    "prophet": 12,
    "gradient_boosting": 24,
}
MAX_PENALTY_SCALE = 3.0
OUTLIER_MAD_MULTIPLIER = 6.0
ENSEMBLE_MEMBERS = 4
ENSEMBLE_IMPROVEMENT = 0.02
CLOSE_SCORE = 0.05

# ---- Intervals (fixed values) ---------------------------------------------
CONFIDENCE = 0.8
SCENARIO_CONFIDENCE = 0.95
MIN_EMPIRICAL = 8
MIN_SIDE_SHARE = 0.1
VOLATILITY_WEIGHT = 0.75
COVERAGE_TOLERANCE = 5.0
MIN_COVERAGE_SAMPLE = 8
MIN_RELATIVE_SIGMA = 1e-9

# ---- Reconciliation (fixed values) ----------------------------------------
MIN_TOTAL = 1e-9
MAX_STRETCH = 2.0
SCALABLE_FRACTION = 1e-6

# ---- Drivers (fixed values) -----------------------------------------------
MIN_ROWS_AFTER_LAG = 12
MAX_DRIVERS = 4
OBSERVATIONS_PER_DRIVER = 20

# ---- Decisions, insights, drift (fixed values) ----------------------------
PLANNABLE_ACCURACY = 75.0
DIRECTIONAL_ACCURACY = 55.0
RELIABLE_BAND_SHARE = 0.6
DIRECTIONAL_SHARE = 0.5
CONCENTRATION_SHARE = 0.5
CONCENTRATION_LIFT = 2.0
MATERIAL_DOWNSIDE = 5.0
ACCURACY_WARNING = 80.0
ANOMALY_Z = 2.5
DOWNSIDE_SEVERE = 15.0
TRACKING_LIMIT = 4.0
DRIFT_WMAPE = 50.0
SIMULATION_WIDENING = 0.5
HEADLINE_RUNS = 3
HEADLINE_PERIODS = 26
SEVERITY_BONUS = {"critical": 30.0, "warning": 15.0, "positive": 5.0, "info": 0.0}
INSIGHT_LIMIT = 8
MAX_PAGE = 200
