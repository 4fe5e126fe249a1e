"""Schemas, level orders and bin edges of the job-risk table."""

from __future__ import annotations

from pyspark.sql import types as T

INF = float("inf")

# The raw table's columns, in file order, with the analysis name of each.
RAW_COLUMNS = [
    ("Job Title", "job_title", T.StringType()),
    ("Industry", "industry", T.StringType()),
    ("Job Status", "job_status", T.StringType()),
    ("AI Impact Level", "ai_impact", T.StringType()),
    ("Median Salary (USD)", "salary", T.DoubleType()),
    ("Required Education", "education", T.StringType()),
    ("Experience Required (Years)", "experience", T.IntegerType()),
    ("Job Openings (2024)", "openings_now", T.IntegerType()),
    ("Projected Openings (2030)", "openings_future", T.IntegerType()),
    ("Remote Work Ratio (%)", "remote", T.DoubleType()),
    ("Automation Risk (%)", "risk", T.DoubleType()),
    ("Location", "location", T.StringType()),
    ("Gender Diversity (%)", "diversity", T.DoubleType()),
]
RAW_SCHEMA = T.StructType([T.StructField(raw, kind, True) for raw, _, kind in RAW_COLUMNS])
RAW_TO_ANALYSIS = {raw: name for raw, name, _ in RAW_COLUMNS}

TARGET = "risk"
KEY = "row_id"
NUMERIC = ["salary", "experience", "openings_now", "openings_future", "remote", "diversity"]
NUMERIC_WITH_TARGET = [*NUMERIC, TARGET]
CATEGORICAL = ["industry", "job_status", "ai_impact", "education", "location"]
COMPARED = ["salary", "experience", "remote", "diversity"]
RADAR = ["salary", "experience", "remote", "diversity", "risk"]

# Bin edges (left-open, right-closed) and their labels.
RISK_EDGES = [-0.01, 30, 60, 100]
RISK_NAMES = ["Low Risk (0-30%)", "Medium Risk (30-60%)", "High Risk (60-100%)"]
RISK_CODES = [0, 1, 2]
RISK_ITEMS = ["Risk_Low", "Risk_Medium", "Risk_High"]
EXPERIENCE_EDGES = [-1, 2, 5, 10, 20, 100]
EXPERIENCE_LEVELS = ["Entry", "Junior", "Mid", "Senior", "Expert"]
EXPERIENCE_ITEMS = ["Exp_Entry", "Exp_Junior", "Exp_Mid", "Exp_Senior", "Exp_Expert"]
SALARY_EDGES = [0, 60000, 90000, 120000, 150000]
SALARY_LEVELS = ["Low", "Medium", "High", "VeryHigh"]
SALARY_ITEMS = ["Salary_Low", "Salary_Med", "Salary_High", "Salary_VHigh"]
REMOTE_EDGES = [-1, 25, 50, 75, 100]
REMOTE_LEVELS = ["Low", "Medium", "High", "VeryHigh"]
REMOTE_ITEMS = ["Remote_Low", "Remote_Med", "Remote_High", "Remote_VHigh"]
DIVERSITY_EDGES = [0, 35, 50, 65, 100]
DIVERSITY_ITEMS = ["Diversity_Low", "Diversity_Med", "Diversity_High", "Diversity_VHigh"]
GROWTH_EDGES = [-INF, -0.3, 0, 0.3, 1, INF]
GROWTH_LEVELS = ["SevereDecline", "ModerateDecline", "Stable", "ModerateGrowth", "HighGrowth"]
GROWTH_LABELS = ["大幅缩减", "小幅缩减", "平稳", "小幅增长", "大幅增长"]

# Ordinal codes and item names. Education is spelled with U+2019 in the data.
EDUCATION_ORDER = [
    "High School",
    "Associate Degree",
    "Bachelor’s Degree",
    "Master’s Degree",
    "PhD",
]
IMPACT_ORDER = ["Low", "Moderate", "High"]
STATUS_ORDER = ["Decreasing", "Increasing"]
GROWTH_ITEMS = {"Increasing": "Growth_Inc", "Decreasing": "Growth_Dec"}
IMPACT_ITEMS = {"Low": "AI_Low", "Moderate": "AI_Moderate", "High": "AI_High"}
EXPERIENCE_ORDER = EXPERIENCE_LEVELS

# The order of the prepared matrix's columns between the numeric ones and the dummies.
DERIVED = [
    "growth_rate",
    "salary_per_experience",
    "job_density",
    "salary_remote_interaction",
    "growth_impact_interaction",
    "salary_experience_interaction",
    "diversity_growth_interaction",
    "remote_growth_interaction",
    "salary_zscore",
]
CODES = [
    "education_encoded",
    "impact_encoded",
    "status_encoded",
    "experience_level_encoded",
    "salary_level_encoded",
    "remote_level_encoded",
    "growth_category_encoded",
]

TRANSACTION_COLUMNS = [
    "industry",
    "risk_level",
    "salary_level",
    "exp_level",
    "remote_level",
    "diversity_level",
    "growth_trend",
    "ai_item",
    "education",
]
