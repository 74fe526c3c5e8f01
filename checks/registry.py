"""All registered checks."""

from __future__ import annotations

from checks import history_checks, lifecycle_checks, market_checks, metric_checks, model_checks, quality_checks, search_checks, staged_checks, text_checks  # noqa: F401
from checks.spec import CHECKS

__all__ = ["CHECKS"]
