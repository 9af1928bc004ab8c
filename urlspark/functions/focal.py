"""Focal-loss expressions for a raw score z and a 0/1 label y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlspark import constants as K

_EPS = 1e-15


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def class_prob(y: Column, p: Column) -> Column:
    """Probability given to the true class, kept inside (0, 1)."""
    return F.least(F.greatest(F.when(y == 1, p).otherwise(1.0 - p), F.lit(_EPS)), F.lit(1.0 - _EPS))


def class_weight(y: Column, alpha: float) -> Column:
    return F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))


def _finite(value: Column) -> Column:
    return F.when(F.isnan(value) | value.isNull(), F.lit(0.0)).otherwise(value)


def gradient(y: Column, p: Column, gamma: float = K.FOCAL_GAMMA, alpha: float = K.FOCAL_ALPHA) -> Column:
    """d(loss)/dz with loss = -a (1-pt)^gamma ln(pt)."""
    pt = class_prob(y, p)
    sign = F.when(y == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    factor = gamma * F.ln(pt) - (1.0 - pt) / pt
    return _finite(curvature(y, p, gamma, alpha) * sign * factor)


def curvature(y: Column, p: Column, gamma: float = K.FOCAL_GAMMA, alpha: float = K.FOCAL_ALPHA) -> Column:
    """Always non-negative stand-in for the second derivative."""
    pt = class_prob(y, p)
    return _finite(class_weight(y, alpha) * p * (1.0 - p) * F.pow(1.0 - pt, F.lit(gamma - 1.0)))


def loss(y: Column, p: Column, gamma: float = K.FOCAL_GAMMA, alpha: float = K.FOCAL_ALPHA) -> Column:
    pt = class_prob(y, p)
    return -class_weight(y, alpha) * F.pow(1.0 - pt, F.lit(gamma)) * F.ln(pt)
