"""Scalar functions (inventory F1-F8 and the credibility formula of T2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def presence_flag(c: str | Column) -> Column:
    """1 when the value is present, 0 when it is null."""
    return F.when(F.isnull(_col(c)), F.lit(0)).otherwise(F.lit(1))


def decayed_weight(setting: str | Column, age_days: str | Column, chronic_flag: str | Column,
                   setting_weights: dict[str, float] | None = None,
                   half_life_days: dict[str, float] | None = None,
                   default_weight: float = 1.0, default_half_life: float = 365.0) -> Column:
    """Weight of one coded visit = setting weight * 0.5 ** (age / half-life of its class).

    Inpatient visits count double, and chronic conditions fade with a two-year half-life
    against one year for the others (the build's defaults)."""
    setting_weights = setting_weights or {"IP": 2.0}
    half_life_days = half_life_days or {"1": 730.0}
    w = F.lit(float(default_weight))
    for k, v in reversed(list(setting_weights.items())):
        w = F.when(_col(setting) == k, F.lit(float(v))).otherwise(w)
    hl = F.lit(float(default_half_life))
    for k, v in reversed(list(half_life_days.items())):
        hl = F.when(_col(chronic_flag) == k, F.lit(float(v))).otherwise(hl)
    return w * F.pow(F.lit(0.5), _col(age_days).cast("double") / hl)


def sqrt_credibility(credibility: str | Column) -> Column:
    """square-root damped credibility."""
    return F.sqrt(_col(credibility))


def log_credibility(credibility: str | Column) -> Column:
    """log-damped credibility (log1p keeps zero at zero)."""
    return F.log1p(_col(credibility))


def dot(a: str | Column, b: str | Column) -> Column:
    """F8: dot product of two equally long numeric arrays, as a higher-order expression."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def labelled(c: str | Column, levels: Sequence[tuple[object, str]]) -> tuple[Column, Column]:
    """value -> display label with an ordered level list. Values outside the list map to
    null (no ``otherwise``), as a factor does. Returns (label, 1-based level order)."""
    label = None
    order = None
    for i, (value, text) in enumerate(levels, start=1):
        cond = _col(c) == F.lit(value)
        label = F.when(cond, F.lit(text)) if label is None else label.when(cond, F.lit(text))
        order = F.when(cond, F.lit(i)) if order is None else order.when(cond, F.lit(i))
    return label, order
