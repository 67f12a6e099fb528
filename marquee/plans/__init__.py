from marquee.plans.catalogue import QUERIES
from marquee.plans.checks import ORACLES
from marquee.plans.store_queries import (
    STORE_QUERIES,
    Choices,
    calendar_reports,
    run_report,
)

__all__ = [
    "ORACLES",
    "QUERIES",
    "STORE_QUERIES",
    "Choices",
    "calendar_reports",
    "run_report",
]
