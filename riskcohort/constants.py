"""Fixed values.

Everything in this module is data the results depend on: codes, thresholds, labels, accepted
input tokens. It is kept together so that a change of policy is a change in one place.
Limits are floats on purpose: comparisons then run on binary doubles in every engine.
"""

from __future__ import annotations

# --- predictors, target, forbidden columns -------------------------------------------------
PREDICTORS = (
    "age", "sex", "bmi", "race_ethnicity",
    "family_history", "hypertension", "physical_activity", "smoking_status",
)
NUMERIC_PREDICTORS = ("age", "bmi")
CATEGORICAL_PREDICTORS = (
    "sex", "race_ethnicity", "family_history",
    "hypertension", "physical_activity", "smoking_status",
)
TARGET = "diabetes_risk"
ID_COLUMNS = ("SEQN", "cycle")
DATASET_COLUMNS = (*ID_COLUMNS, *PREDICTORS, "diq010", TARGET)
LAB_COLUMNS = ("hba1c", "lbxgh", "glucose", "fasting_glucose", "lbxglu")
FORBIDDEN_FEATURES = ("diq010", "SEQN", "cycle", *LAB_COLUMNS)

# Display order of the classes, and the alphabetical order models encode them in.
CLASS_LABELS = ("Low", "Moderate", "High")
ENCODED_LABELS = ("High", "Low", "Moderate")

# --- survey modules ------------------------------------------------------------------------
CYCLES = ("2013-2014", "2015-2016", "2017-2018")
MODULE_COLUMNS = {
    "demo": ("SEQN", "RIDAGEYR", "RIAGENDR", "RIDRETH3"),
    "bmx": ("SEQN", "BMXBMI"),
    "diq": ("SEQN", "DIQ010"),
    "mcq": ("SEQN", "MCQ300C"),
    "bpq": ("SEQN", "BPQ020"),
    "paq": ("SEQN", "PAQ650", "PAQ665"),
    "smq": ("SEQN", "SMQ020", "SMQ040"),
    "ghb": ("SEQN", "LBXGH"),
    "glu": ("SEQN", "LBXGLU"),
}
INNER_MODULES = ("bmx", "diq", "mcq", "bpq", "paq", "smq")
LEFT_MODULES = ("ghb", "glu")
ADULT_MIN_AGE = 20.0
ADULT_MIN_AGE_BINARY = 18.0
SEX_CODES = (1, 2)
RACE_CODES = (1, 2, 3, 4, 6, 7)
BMI_PLAUSIBLE = (10.0, 80.0)

# --- display labels ------------------------------------------------------------------------
RACE_LABELS = {
    1: "Mexican American",
    2: "Other Hispanic",
    3: "Non-Hispanic White",
    4: "Non-Hispanic Black",
    6: "Non-Hispanic Asian",
    7: "Other / Multi-racial",
}
SEX_LABELS = {1: "Male", 2: "Female"}
YES_NO_LABELS = {1: "Yes", 0: "No"}
ACTIVITY_LABELS = {1: "Active", 0: "Inactive"}
SMOKING_LABELS = {0: "Never", 1: "Former", 2: "Current"}
NOT_PROVIDED = "Not provided"

# --- rule cascade --------------------------------------------------------------------------
HBA1C_DIABETIC = 6.5
HBA1C_PREDIABETIC = (5.7, 6.4)
GLUCOSE_DIABETIC = 126.0
GLUCOSE_PREDIABETIC = (100.0, 125.0)
HIGH_PROBABILITY = 0.70

# --- future-risk evidence limits -----------------------------------------------------------
GLUCOSE_EVIDENCE = (50.45, 126.0)      # lower limit inclusive, upper exclusive
AGE_EVIDENCE = (20.0, 99.0)
BMI_EVIDENCE = (15.0, 52.7)
AGE_USUAL = (25.0, 78.0)
BMI_USUAL = (17.0, 32.2)
GLUCOSE_USUAL = (62.0, 117.65)
RISK_BANDS = (0.01, 0.05)
MGDL_PER_MMOLL = 18.0182

# --- follow-up study -----------------------------------------------------------------------
FOLLOWUP_HEADERS = {
    "id": "participant_id",
    "year of followup": "time_years",
    "censor of diabetes at followup(1, Yes; 0, No)": "event",
    "Age (y)": "age",
    "Gender(1, male; 2, female)": "male",
    "BMI(kg/m2)": "bmi",
    "FPG (mmol/L)": "fpg_mmol_l",
}
FOLLOWUP_FEATURES = ("age", "male", "bmi", "fpg_mmol_l")
FPG_ELIGIBLE = (2.8, 6.999999)
HORIZON_YEARS = 3.0
SURVIVAL_FLOOR = 0.05
FPG_BANDS = (5.6, 6.1)
AGE_BANDS = (30.0, 50.0, 70.0)
BMI_BANDS = (25.0, 30.0)

# --- experiments ---------------------------------------------------------------------------
SEED = 42
TEST_SHARE = 0.20
FOLDS = 5
MIN_F1_GAIN = 0.010
MAX_CLASS_DROP = 0.020
MIN_SEPARATION = 0.2
MUCH_STRONGER = 0.1
GRID_AGES = (20, 30, 40, 50, 60, 70, 80)
GRID_BMIS = (18, 22, 25, 28, 30, 35, 40, 45)

# --- accepted input tokens (compared after trimming and lower-casing) ------------------------
MALE_TOKENS = ("1", "1.0", "male", "m")
FEMALE_TOKENS = ("0", "0.0", "2", "2.0", "female", "f")
MALE_EXTRA = ("man",)
FEMALE_EXTRA = ("woman",)
YES_TOKENS = ("1", "1.0", "yes", "true")
NO_TOKENS = ("0", "0.0", "no", "false")
UNKNOWN_TOKENS = ("unknown", "-1")
NULL_TOKENS = ("null",)
ACTIVE_TOKENS = (*YES_TOKENS, "active")
INACTIVE_TOKENS = (*NO_TOKENS, "inactive")
SMOKING_TOKENS = {
    0.0: ("0", "0.0", "never"),
    1.0: ("1", "1.0", "former"),
    2.0: ("2", "2.0", "current"),
}
LAB_NULL_TOKENS = ("null", "none", "None")   # case-sensitive in the future-risk checks
AGE_LIMIT = 130.0
BMI_LIMIT = 150.0

# --- file audit ----------------------------------------------------------------------------
MIN_FILE_BYTES = 100
