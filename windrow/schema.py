"""Names, domains and schemas every module shares."""

from __future__ import annotations

# The six features, in declaration order (ties are broken by it).
FEATURES = (
    "txn_count_5m",
    "avg_spend_1h",
    "session_activity_rate",
    "cart_abandon_ratio",
    "product_interaction_freq",
    "anomaly_score",
)

# Enumerated domains of the event record.
EVENT_TYPES = ("page_view", "add_to_cart", "purchase", "search", "abandon")
DEVICE_TYPES = ("mobile", "desktop", "tablet")

EVENT_SCHEMA = """
    event_id string, user_id string, session_id string, event_type string,
    timestamp timestamp, transaction_amount double, product_id string, category string,
    location struct<country: string, city: string>, device_type string, schema_version string
"""

# Every event carries these; event_id and schema_version have defaults.
REQUIRED_EVENT_FIELDS = (
    "user_id",
    "session_id",
    "event_type",
    "timestamp",
    "transaction_amount",
    "product_id",
    "category",
    "location",
    "location.country",
    "location.city",
    "device_type",
)

# Default schema version, topics, TTLs and thresholds.
SCHEMA_VERSION = "1.0"
EVENTS_TOPIC = "ecommerce.events.raw"
ALERTS_TOPIC = "ecommerce.alerts.drift"
ALERT_KEY = "skew_alert"
FEATURE_TTL_SECONDS = 300
BASELINE_TTL_SECONDS = 7 * 86400
STALE_TTL_SECONDS = 60
FRESHNESS_SLA_SECONDS = 300
LATENCY_SLA_MS = 50.0
WATERMARK = "10 minutes"
TRIGGER = "30 seconds"

METRIC_SCHEMA = "feature_name string, metric_type string, metric_value double, recorded_at timestamp"
DIAGNOSIS_SCHEMA = """
    feature_name string, probable_cause string, cause_category string, confidence double,
    affected_features array<string>, remediation_steps array<string>, urgency string,
    estimated_impact string, model_used string, tokens_used int, fallback_used boolean,
    computed_at timestamp
"""
