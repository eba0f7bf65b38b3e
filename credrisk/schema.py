"""Client schema, column groups and the fixed values the analyses depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column groups.  The six observed months are held wide; index 1 / PAY_0 is the
# most recent month, index 6 the oldest.  There is no PAY_1.
# ---------------------------------------------------------------------------
PAY_COLS = ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]
BILL_COLS = [f"BILL_AMT{i}" for i in range(1, 7)]
PAY_AMT_COLS = [f"PAY_AMT{i}" for i in range(1, 7)]
CAT_COLS = ["GENDER", "EDUCATION", "MARRIAGE"]

RAW_TARGET = "default.payment.next.month"
TARGET = "DEFAULT"

# Raw client record as it arrives (CSV header order).
CLIENT_RAW = T.StructType(
    [T.StructField("ID", T.LongType()),
     T.StructField("LIMIT_BAL", T.LongType()),
     T.StructField("SEX", T.IntegerType()),
     T.StructField("EDUCATION", T.IntegerType()),
     T.StructField("MARRIAGE", T.IntegerType()),
     T.StructField("AGE", T.IntegerType())]
    + [T.StructField(c, T.IntegerType()) for c in PAY_COLS]
    + [T.StructField(c, T.LongType()) for c in BILL_COLS]
    + [T.StructField(c, T.LongType()) for c in PAY_AMT_COLS]
    + [T.StructField(RAW_TARGET, T.IntegerType())]
)

# Engineered features, in the order of the 32-column training frame.
ENGINEERED = ["UTIL_RATE", "PAY_RATIO", "AVG_PAY_STATUS", "TOTAL_BILL", "TOTAL_PAY",
              "BILL_TREND", "PAY_TREND", "MAX_PAY_DELAY", "CONSEC_LATE"]
FEATURES = (["LIMIT_BAL", "GENDER", "EDUCATION", "MARRIAGE", "AGE"]
            + PAY_COLS + BILL_COLS + PAY_AMT_COLS + ENGINEERED)

# Numeric columns of the statistical summary and the correlation matrix.
PROFILE_COLS = ["LIMIT_BAL", "AGE"] + BILL_COLS + PAY_AMT_COLS
CORR_COLS = ["LIMIT_BAL", "AGE"] + PAY_COLS + BILL_COLS + PAY_AMT_COLS + [TARGET]
# Engineered features shown on the feature page.
PROFILE_FEATURES = ["UTIL_RATE", "PAY_RATIO", "AVG_PAY_STATUS", "TOTAL_BILL", "TOTAL_PAY"]
# Variables selectable for the distribution charts.
HIST_COLS = PROFILE_COLS + ["UTIL_RATE", "PAY_RATIO"]
# Numeric columns of the linear preparation (standard-scaled).
NUM_BASE_COLS = ["LIMIT_BAL", "AGE", "UTIL_RATE", "PAY_RATIO", "TOTAL_BILL", "TOTAL_PAY",
                 "AVG_PAY_STATUS", "BILL_TREND", "PAY_TREND", "MAX_PAY_DELAY", "CONSEC_LATE"]

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference application's for the same
# results: label dictionaries, bins, bands, tiers and factor thresholds.
# ---------------------------------------------------------------------------
SEX_LABELS = {1: "Male", 2: "Female"}
EDU_LABELS = {1: "Graduate School", 2: "University", 3: "High School", 4: "Others",
              5: "Unknown", 6: "Unknown"}
EDU_FALLBACK = "Others"
MAR_LABELS = {1: "Married", 2: "Single", 3: "Others"}
MAR_FALLBACK = "Others"
DEFAULT_LABELS = {0: "No Default", 1: "Default"}
PAY_STATUS_LABELS = {-2: "-2 (No consumption)", -1: "-1 (Paid on time)", 0: "0 (Revolving)",
                     1: "1 (1 month late)", 2: "2 months late", 3: "3 months late",
                     4: "4 months late", 5: "5 months late", 6: "6 months late",
                     7: "7 months late", 8: "8+ months late"}
# Right-closed age bins (lo, hi] and their labels.
AGE_EDGES = [20, 25, 30, 35, 40, 45, 50, 60, 80]
AGE_LABELS = ["21-25", "26-30", "31-35", "36-40", "41-45", "46-50", "51-60", "60+"]
# Default-rate severity band: > 25 high, > 20 medium, else low.
RATE_BANDS = [(25.0, "high"), (20.0, "medium")]
RATE_BAND_ELSE = "low"
# Risk tiers on the probability in percent: < 15, < 35, < 60, else.
TIERS = [(15.0, "LOW RISK"), (35.0, "MODERATE RISK"), (60.0, "HIGH RISK")]
TIER_ELSE = "CRITICAL RISK"
TIER_VERDICTS = {
    "LOW RISK": "This customer profile is unlikely to default. The bank can confidently extend or maintain credit.",
    "MODERATE RISK": "This customer shows some risk signals. The bank should monitor closely and may consider limit restrictions.",
    "HIGH RISK": "Significant default risk. The bank should initiate outreach, reduce limit, and begin early intervention.",
    "CRITICAL RISK": "Very high probability of default. Immediate action required — collections outreach, account freeze, or settlement offer.",
}
# Factor analysis thresholds.
UTIL_HIGH, UTIL_MODERATE = 0.75, 0.3
DELAY_HIGH, DELAY_MODERATE = 2, 0
COVERAGE_HIGH, COVERAGE_MODERATE = 0.1, 0.3
LIMIT_LOW, LIMIT_MODERATE = 200000, 80000
FACTOR_SCALE_MONTHS = 8
LIMIT_SCALE = 1_000_000
# Clip ranges: train / score variant and dashboard variant.
UTIL_CLIP_TRAIN, UTIL_CLIP_DASH = (-1.0, 2.0), (0.0, 2.0)
RATIO_CLIP_TRAIN, RATIO_CLIP_DASH = (-2.0, 5.0), (0.0, 5.0)
# Delinquency stages (label, days past due).  Months late on the latest
# status map to days as 30 per month with right-closed edges (lo, hi].
DELINQUENCY_STAGES = [("Normal Use", "Current"), ("Rising Utilization", "0 DPD"),
                      ("Payment Delay", "1–30 DPD"), ("Delinquency", "30–60 DPD"),
                      ("Serious Delinquency", "60–90 DPD"), ("Default", "90+ DPD")]
# Classification thresholds used by the model groups.
THRESHOLD_BASELINE = 0.5
THRESHOLD_REBALANCED = 0.3
SEED = 42
TEST_FRACTION = 0.2
N_FOLDS = 5
SMOTE_K = 5
SMOTE_RATIO = 0.5
TOP_K_IMPORTANCES = 15
HIST_BINS = 50
HIST_BINS_FEATURES = 40

# Data dictionary: allowed domain per raw column (lo, hi) inclusive, or a value list.
DOMAINS = {
    "LIMIT_BAL": (10000, 1000000),
    "SEX": [1, 2],
    "EDUCATION": [1, 2, 3, 4, 5, 6],
    "MARRIAGE": [1, 2, 3],
    "AGE": (21, 79),
    "PAY_0": (-2, 9),
    **{c: (-2, 8) for c in PAY_COLS[1:]},
    **{c: (0, None) for c in BILL_COLS},
    **{c: (0, None) for c in PAY_AMT_COLS},
    RAW_TARGET: [0, 1],
}
# Factor names of the score explanation, in display order.
FACTOR_NAMES = ["Credit Utilization", "Recent Payment Status (Sep)", "Avg Payment Delay (6 months)",
                "Payment Coverage", "Credit Limit (Higher = safer)"]

# Deterministic scorecard (FIXTURES.md §3): intercept and coefficients of
# max(PAY_0,0), max(PAY_2,0), UTIL_RATE and PAY_RATIO; score rounded to 4 dp.
SCORECARD = {"intercept": -2.2, "pay0": 0.45, "pay2": 0.15, "util": 0.3, "ratio": -0.5}
# Leaderboard group names.
GROUP_BASELINE, GROUP_IMBALANCE, GROUP_TUNED = "1. Baseline", "2. Imbalance Handled", "3. Tuned"
