"""Screening of text messages for personal data, credentials, injection and toxicity on Spark."""

from .config import ScreenConfig
from .operators.anonymize import anonymize, explode_entities
from .operators.rollups import scan_metrics, session_rollup, violation_rollup
from .operators.routing import accepted, quarantined, rejected, route
from .operators.scores import learn_lexicon
from .plans.scan import scan, scan_distinct, scan_wide

__all__ = [
    "ScreenConfig",
    "accepted",
    "anonymize",
    "explode_entities",
    "learn_lexicon",
    "quarantined",
    "rejected",
    "route",
    "scan",
    "scan_distinct",
    "scan_metrics",
    "scan_wide",
    "session_rollup",
    "violation_rollup",
]
