"""Fixed values that results depend on.

Everything in this module is a plain constant: schema names, seeds, scenario
sizes, test tables and search ranges. They have to keep these exact values for
results to be comparable with published ones.
"""

from __future__ import annotations

SEED = 42
TEST_FRACTION = 0.20
CV_FOLDS = 5

# Schema of a sensor table.
TARGET = "Class"
POSITIVE = "Bad"
NEGATIVE = "Good"
HEADER_REPAIRS = {"Humid (%)": "Humidity", "Light (Fux)": "Light", "CO2 (pmm)": "CO2"}
SENSORS = ["Temp", "Humidity", "Light", "CO2"]
GROUP = "Fruit"
FEATURES = SENSORS + [GROUP]
UNITS = {"Temp": "°C", "Humidity": "%", "Light": "Lux", "CO2": "ppm"}

# Physical limits kept after a perturbation.
HUMIDITY_CEILING = 100.0
LIGHT_FLOOR = 0.0

# Perturbation scenarios: label -> offset per sensor.
SINGLE_SHIFTS = {
    "Temp +1C": {"Temp": 1.0},
    "Temp +2C": {"Temp": 2.0},
    "Humidity +5%": {"Humidity": 5.0},
    "Humidity -5%": {"Humidity": -5.0},
    "CO2 +20ppm": {"CO2": 20.0},
    "CO2 -20ppm": {"CO2": -20.0},
    "Light +20Lux": {"Light": 20.0},
    "Light -20Lux": {"Light": -20.0},
}
COMBINED_SHIFTS = {
    "Temp +2C & Humidity -5%": {"Temp": 2.0, "Humidity": -5.0},
    "Temp +1C & CO2 +20ppm": {"Temp": 1.0, "CO2": 20.0},
    "Light -20Lux & Humidity +5%": {"Light": -20.0, "Humidity": 5.0},
    "All sensors biased": {"Temp": 2.0, "Humidity": -5.0, "Light": -20.0, "CO2": 20.0},
}
DRIFTS = {
    "Drift Light -> -40Lux": {"Light": -40.0},
    "Drift Temp -> +3C": {"Temp": 3.0},
    "Drift all sensors": {"Temp": 3.0, "Humidity": -10.0, "Light": -40.0, "CO2": 40.0},
}
NOISE_SIGMA = {"Temp": 1.0, "Humidity": 3.0, "Light": 10.0, "CO2": 20.0}
NOISE_LEVELS = [0.5, 1.0, 2.0, 3.0]
NOISE_REPEATS = 5

# Decision band, budgets and flags.
BORDER_LOW = 0.4
BORDER_HIGH = 0.6
SIZE_BUDGET_KB = 500.0
LATENCY_BUDGET_MS = 1.0
LEAKAGE_FLAG = 0.98
IQR_REACH = 1.5
PROBABILITY_CLIP = 1e-15

# Critical values of the studentised range / sqrt(2) at alpha = 0.05, by number of models.
NEMENYI_Q05 = {
    2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102,
    10: 3.164, 11: 3.219, 12: 3.268, 13: 3.313, 14: 3.354, 15: 3.391, 16: 3.426,
}
NEMENYI_Q05_BEYOND = 3.426

# Below this many discordant pairs McNemar's test is exact.
MCNEMAR_EXACT_BELOW = 25

# Metric columns in report order; the last two are better when lower.
METRICS = [
    "accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc",
    "pr_auc", "mcc", "cohen_kappa", "log_loss", "brier_score",
]

# Model name -> (family, scaled inputs).
MODEL_FAMILIES = {
    "Logistic Regression": ("Linear", True),
    "Ridge Classifier": ("Linear", True),
    "SGD Classifier": ("Linear", True),
    "Decision Tree": ("Tree", False),
    "Random Forest": ("Tree", False),
    "Extra Trees": ("Tree", False),
    "AdaBoost": ("Boosting", False),
    "Gradient Boosting": ("Boosting", False),
    "XGBoost": ("Boosting", False),
    "LightGBM": ("Boosting", False),
    "CatBoost": ("Boosting", False),
    "KNN": ("Other", True),
    "GaussianNB": ("Other", True),
    "SVM": ("Other", True),
    "MLP": ("Other", True),
}

# Search ranges: parameter -> (kind, low, high[, step]) or ("choice", options).
SEARCH_SPACES = {
    "Random Forest": {
        "n_estimators": ("int", 100, 600, 50),
        "max_depth": ("int", 3, 20, 1),
        "min_samples_split": ("int", 2, 20, 1),
        "min_samples_leaf": ("int", 1, 10, 1),
        "max_features": ("choice", ["sqrt", "log2", "all"]),
    },
    "XGBoost": {
        "n_estimators": ("int", 100, 600, 50),
        "max_depth": ("int", 2, 10, 1),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("float", 0.6, 1.0),
        "colsample_bytree": ("float", 0.6, 1.0),
        "min_child_weight": ("int", 1, 10, 1),
        "gamma": ("float", 0.0, 5.0),
    },
    "LightGBM": {
        "n_estimators": ("int", 100, 600, 50),
        "num_leaves": ("int", 15, 127, 1),
        "max_depth": ("int", 3, 15, 1),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("float", 0.6, 1.0),
        "colsample_bytree": ("float", 0.6, 1.0),
        "min_child_samples": ("int", 5, 50, 1),
    },
    "CatBoost": {
        "iterations": ("int", 100, 600, 50),
        "depth": ("int", 3, 10, 1),
        "learning_rate": ("log", 0.01, 0.3),
        "l2_leaf_reg": ("float", 1.0, 10.0),
    },
}

# Feature subsets compared for their effect on cross-validated F1.
FEATURE_SUBSETS = {
    "All features": ["Temp", "Humidity", "Light", "CO2", "Fruit"],
    "Sensors only (no Fruit)": ["Temp", "Humidity", "Light", "CO2"],
    "Top-3 (Light,Humidity,Temp)": ["Light", "Humidity", "Temp"],
    "Top-2 (Light,Humidity)": ["Light", "Humidity"],
    "Light only": ["Light"],
    "No Light": ["Temp", "Humidity", "CO2", "Fruit"],
}

RULE_DEPTHS = [1, 2, 3, 4, 5, 6, 8, 10, 12, 0]  # 0 = unlimited
