"""Probability columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clipping used by the calibrator and by the log loss.
CALIBRATOR_CLIP = 1e-9
LOSS_CLIP = 1e-12


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, eps: float) -> Column:
    """Clamp to [eps, 1 - eps]; NULL stays NULL (``greatest`` would hide it)."""
    p = col(c)
    return F.when(p < eps, F.lit(eps)).when(p > 1 - eps, F.lit(1 - eps)).otherwise(p)


def logit(c: str | Column, eps: float = CALIBRATOR_CLIP) -> Column:
    p = clip(c, eps)
    return F.ln(p / (1 - p))


def sigmoid(c: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def beta_shrink(
    successes: str | Column, starts: str | Column, prior: str | float | Column, strength: float = 6.0
) -> Column:
    """Posterior mean of a rate under a Beta prior of the given mean and weight.

    Impossible counts fail the job; unknown counts stay NULL.
    """
    s, n = col(successes), col(starts)
    mean = F.lit(prior) if isinstance(prior, (int, float)) else col(prior)
    bad = (s < 0) | (n < 0) | (s > n)
    failed = F.raise_error(F.lit("successes and starts must satisfy 0 <= successes <= starts"))
    return F.when(bad, failed.cast("double")).otherwise((s + mean * strength) / (n + strength))


def field_size_baseline(n: str | Column, slots: float = 3.0) -> Column:
    """Exchangeable P(label) = slots / field size, defined for fields larger than ``slots``."""
    return F.when(col(n) > slots, clip(F.lit(slots) / col(n), LOSS_CLIP))


def convex_blend(market: str | Column, model: str | Column, weight: float | Column) -> Column:
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return (1 - w) * col(market) + w * col(model)


def apply_logit_calibrator(p: str | Column, intercept: str | Column, slope: str | Column) -> Column:
    return sigmoid(col(intercept) + col(slope) * logit(p))


def brier(p: str | Column, y: str | Column) -> Column:
    gap = col(p) - col(y)
    return gap * gap


def log_loss(p: str | Column, y: str | Column) -> Column:
    q = clip(p, LOSS_CLIP)
    return -(col(y) * F.ln(q) + (1 - col(y)) * F.log1p(-q))
