"""Ideology scores and ratio statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.dims import HIST_BINS, IDEOLOGY_CENTER, IDEOLOGY_LEFT, IDEOLOGY_RIGHT


def ideology_sign(score: Column) -> Column:
    """negative / positive; zero and missing scores have no sign."""
    return F.when(score < 0, "negative").when(score > 0, "positive")


def ideology_bin(score: Column) -> Column:
    """Bins (-1, -0.1], (-0.1, 0.1] and (0.1, 1]: exactly -1 is in none of them."""
    return (
        F.when((score > -1) & (score <= -0.1), IDEOLOGY_LEFT)
        .when((score > -0.1) & (score <= 0.1), IDEOLOGY_CENTER)
        .when((score > 0.1) & (score <= 1), IDEOLOGY_RIGHT)
    )


def hist_edges(bins: int = HIST_BINS) -> list[float]:
    step = 2 / bins
    return [i * step - 1 for i in range(bins)] + [1.0]


def hist_bin(score: Column, bins: int = HIST_BINS) -> Column:
    """1-based equal-width bin over [-1, 1]; only the last bin holds its right edge."""
    edges = F.array(*(F.lit(e) for e in hist_edges(bins)))
    passed = F.size(F.filter(edges, lambda edge: edge <= score))
    return F.when(score.between(-1, 1), F.least(passed, F.lit(bins)))


def oe_ratio(observed: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.try_divide(observed, expected))


def oe_bound(observed: Column, expected: Column, z: float) -> Column:
    """Bound of the ratio ``z`` standard errors away on the log scale."""
    usable = (observed > 0) & (expected > 0)
    log_ratio = F.log(F.when(usable, observed / expected))
    return F.exp(log_ratio + z / F.sqrt(F.when(usable, observed)))


Z_95 = 1.96


def oe_ratio_ci(observed: Column, expected: Column) -> dict[str, Column]:
    """Ratio, 95 % interval and the two error-bar lengths (never below zero)."""
    ratio = oe_ratio(observed, expected)
    lower = oe_bound(observed, expected, -Z_95)
    upper = oe_bound(observed, expected, Z_95)
    zero = F.lit(0.0)
    return {
        "ratio": ratio,
        "ci_lower": lower,
        "ci_upper": upper,
        "err_low": F.when(lower.isNotNull(), F.greatest(ratio - lower, zero)),
        "err_high": F.when(upper.isNotNull(), F.greatest(upper - ratio, zero)),
    }
