"""Column roles, domains and rules of the documented telco customer table.

These are the defaults of the operators; callers with other tables pass their
own roles, domains and rules as arguments.
"""

from __future__ import annotations

from segstats.operators.quality import Implication, QualityConfig
from segstats.operators.roles import Roles

# --- Fixed values: the documented telco schema ---------------------------------
TELCO_ROLES = Roles(label="Churn", measure="tenure", positive="Yes", negative="No")
CONTRACT_COLUMN = "Contract"
CONTRACT_VALUES = ("Month-to-month", "One year", "Two year")
ID_COLUMN = "customerID"
TOTAL_CHARGES_COLUMN = "TotalCharges"
NON_CATEGORICAL_TEXT_COLUMNS = (ID_COLUMN, TOTAL_CHARGES_COLUMN)
EARLY_TENURE_BOUNDS = (0, 6)
TENURE_BIN_WIDTH = 6
TENURE_MINIMUM = 0
SENIOR_CITIZEN_VALUES = (0, 1)
TOTAL_CHARGES_CONTEXT = ("customerID", "tenure", "MonthlyCharges", "TotalCharges", "Churn")
TENURE_CONTEXT = ("customerID", "tenure", "MonthlyCharges", "TotalCharges", "Contract", "InternetService", "Churn")
SENIOR_CITIZEN_CONTEXT = ("customerID", "SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "Churn")

NO_INTERNET_RULE = Implication(
    name="no_internet_service",
    trigger="InternetService",
    trigger_value="No",
    dependents=("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"),
    expected="No internet service",
)
NO_PHONE_RULE = Implication(
    name="no_phone_service",
    trigger="PhoneService",
    trigger_value="No",
    dependents=("MultipleLines",),
    expected="No phone service",
)

YES_NO = ("Yes", "No")
INTERNET_DEPENDENT = ("Yes", "No", "No internet service")
TELCO_DOMAINS = {
    "gender": ("Male", "Female"),
    "Partner": YES_NO,
    "Dependents": YES_NO,
    "PhoneService": YES_NO,
    "MultipleLines": ("Yes", "No", "No phone service"),
    "InternetService": ("DSL", "Fiber optic", "No"),
    "OnlineSecurity": INTERNET_DEPENDENT,
    "OnlineBackup": INTERNET_DEPENDENT,
    "DeviceProtection": INTERNET_DEPENDENT,
    "TechSupport": INTERNET_DEPENDENT,
    "StreamingTV": INTERNET_DEPENDENT,
    "StreamingMovies": INTERNET_DEPENDENT,
    "Contract": CONTRACT_VALUES,
    "PaperlessBilling": YES_NO,
    "PaymentMethod": ("Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)"),
    "Churn": YES_NO,
}
# -------------------------------------------------------------------------------

TELCO_QUALITY = QualityConfig(
    id_column=ID_COLUMN,
    exclude_categorical=NON_CATEGORICAL_TEXT_COLUMNS,
    rules=(NO_INTERNET_RULE, NO_PHONE_RULE),
    numeric_text_column=TOTAL_CHARGES_COLUMN,
    minimums={"tenure": TENURE_MINIMUM},
    domains={"SeniorCitizen": SENIOR_CITIZEN_VALUES},
    range_columns=("MonthlyCharges",),
    blank_context_column="tenure",
    contexts={
        TOTAL_CHARGES_COLUMN: TOTAL_CHARGES_CONTEXT,
        "tenure": TENURE_CONTEXT,
        "SeniorCitizen": SENIOR_CITIZEN_CONTEXT,
    },
)
