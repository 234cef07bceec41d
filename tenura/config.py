"""Default settings. Every operator takes them as arguments; nothing is read from hidden state."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the domain: schemas, categories, limits and costs.
SCHEMAS = {
    "locations": {"location_id": "string", "region": "string", "is_urban": "bool", "capacity": "int64",
                  "monthly_operating_cost": "int64", "staff_retention_hours": "int64"},
    "members": {"member_id": "string", "location_id": "string", "join_date": "string", "cancel_date": "string",
                "churned": "bool", "contract_source": "string", "aggregator_platform": "string",
                "plan_type": "string", "monthly_price": "float64", "age": "int64", "gender": "string",
                "name": "string", "email": "string", "cpf": "string"},
    "visits": {"member_id": "string", "location_id": "string", "visit_date": "string",
               "visit_duration_minutes": "int64"},
    "retention_actions": {"member_id": "string", "location_id": "string", "action_date": "string",
                          "action_type": "string", "cost": "float64"},
}
CONTRACT_SOURCES = ["regular", "aggregator"]
PLAN_TYPES = ["basic", "standard", "premium", "aggregator_standard"]
PLATFORMS = ["gympass", "totalpass", "wellhub", "none"]
GENDERS = ["F", "M"]
ACTION_TYPES = ["sms_reengagement", "phone_call", "discount_offer", "pt_session"]
ACTION_ALIASES = {"personal_trainer_session": "pt_session"}
VISIT_WINDOWS = [7, 14, 30, 60, 90]
NULL_LIMITS = {"location_id": 0.0, "join_date": 0.0, "contract_source": 0.0, "monthly_price": 0.01}
AGE_BINS = [0, 25, 35, 45, 55, 100]
AGE_LABELS = ["18-24", "25-34", "35-44", "45-54", "55+"]
TENURE_BINS = [0, 3, 6, 12, 24]
TENURE_LABELS = ["0-3m", "3-6m", "6-12m", "12-24m", "24m+"]
MODEL_EXCLUDED = ["member_id", "location_id", "name", "email", "cpf", "phone", "address",
                  "cancel_date", "churned"]
PII_FIELDS = ["member_name", "cpf", "email", "phone", "address"]
MASK_TOKEN = "[REDACTED]"
BLOCKED_SQL = ["DROP TABLE", "DELETE FROM", "UPDATE.*SET", "ALTER TABLE"]
DRIFT_FEATURES = ["visit_frequency_30d", "days_since_last_visit", "tenure_months", "monthly_price",
                  "payment_delay_flag"]


# Cleaning rules, retention actions with cost and minutes, and budget limits.
@dataclass(frozen=True)
class MemberRules:
    reenrollment_window_days: int = 30
    min_minutes: int = 5
    max_minutes: int = 300
    contract_sources: tuple[str, ...] = tuple(CONTRACT_SOURCES)
    plan_types: tuple[str, ...] = tuple(PLAN_TYPES)
    null_limits: dict[str, float] = field(default_factory=lambda: dict(NULL_LIMITS))


@dataclass(frozen=True)
class Action:
    name: str
    cost: float
    minutes: float
    eligible: tuple[str, ...] = ("regular", "aggregator")


ACTIONS = (
    Action("sms_reengagement", 2.5, 0),
    Action("phone_call", 15.0, 10),
    Action("discount_offer", 50.0, 2, ("regular",)),
    Action("pt_session", 80.0, 60),
)


@dataclass(frozen=True)
class Limits:
    total_budget: float = 50_000.0
    min_per_location: float = 50.0
    max_per_location: float = 2_000.0
    staff_hours: float = 20.0


# The columns of the treatment frame by their part in the causal model, and treatments a segment cannot get.
@dataclass(frozen=True)
class CausalSpec:
    """Treatment, outcome and adjustment set; frozen so a fit cannot change it."""

    treatment: str = "retention_action_taken"
    outcome: str = "churned_30d"
    confounders: tuple[str, ...] = ("visit_frequency", "tenure_months", "plan_price", "location_churn_rate", "enrollment_month", "payment_delay_flag")
    modifiers: tuple[str, ...] = ("tenure_months", "contract_source", "plan_type")
    instruments: tuple[str, ...] = ()
    segment_confounders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    excluded_treatments: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "aggregator": ("discount_offer", "plan_upgrade")})
