"""Multi-label losses as Column formulas on logits (forward values only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def bce(x: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """Binary cross entropy, stable for large |x|."""
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    softplus = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return (1 - y) * x + (1 + (w - 1) * y) * softplus


def focal(x: Column, y: Column, gamma: float = 2.0, alpha: float | None = None) -> Column:
    p = sigmoid(x)
    hit = p * y + (1 - p) * (1 - y)
    loss = bce(x, y) * F.pow(1 - hit, F.lit(gamma))
    return loss if alpha is None else loss * (alpha * y + (1 - alpha) * (1 - y))


def asymmetric(x: Column, y: Column, gamma_neg: float = 4.0, gamma_pos: float = 0.0,
               clip: float = 0.05, eps: float = 1e-8) -> Column:
    """Asymmetric loss: separate focus for positives and negatives, shifted negative probability."""
    p = sigmoid(x)
    q = F.least(1 - p + clip, F.lit(1.0)) if clip > 0 else 1 - p
    log_likelihood = y * F.log(F.greatest(p, F.lit(eps))) + (1 - y) * F.log(F.greatest(q, F.lit(eps)))
    hit = p * y + q * (1 - y)
    return -log_likelihood * F.pow(1 - hit, gamma_pos * y + gamma_neg * (1 - y))
