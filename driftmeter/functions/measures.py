"""Scalar metric formulas and banding, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def maintainability_index(sloc: str, cc: str) -> Column:
    """0..100 maintainability from size and complexity columns, without Halstead volume."""
    return F.expr(
        f"greatest(0d, (171d - 0.23d * {cc} - 16.2d * ln(cast(greatest(1, {sloc}) as double))) * 100d / 171d)"
    )


# 3 x high + 2 x medium + 1 x low
WEIGHTED_SMELLS = " + ".join(f"{weight}d * {name}" for name, weight in fixed.SMELL_WEIGHTS.items())


def weighted_smells() -> Column:
    return F.expr(WEIGHTED_SMELLS)


def scaled(value: str, low: str, high: str) -> str:
    """Min-max scaling as SQL; 0 when the range is empty."""
    return f"coalesce(try_divide({value} - {low}, {high} - {low}), 0d)"


def band_above(value: Column, scale: Sequence[tuple[float | None, str]]) -> Column:
    """First label whose strict lower bound the value exceeds; the last label has no bound."""
    label = F.lit(scale[-1][1])
    for bound, name in reversed(scale[:-1]):
        label = F.when(value > F.lit(bound), F.lit(name)).otherwise(label)
    return label


def band_below(value: Column, scale: Sequence[tuple[float | None, str]], inclusive: bool = False) -> Column:
    """First label whose upper bound the value stays below (or reaches, if inclusive)."""
    label = F.lit(scale[-1][1])
    for bound, name in reversed(scale[:-1]):
        test = value <= F.lit(bound) if inclusive else value < F.lit(bound)
        label = F.when(test, F.lit(name)).otherwise(label)
    return label


def drift_grade(entropy: Column) -> Column:
    return band_below(entropy, fixed.DRIFT_GRADES)


def badge_band(entropy: Column) -> Column:
    return band_below(entropy, fixed.BADGE_BANDS)


def trend_label(delta: Column, dead_zone: float = fixed.MIN_NOTABLE_DELTA) -> Column:
    return (
        F.when(delta > dead_zone, F.lit("worsening"))
        .when(delta < -dead_zone, F.lit("improving"))
        .when(delta.isNotNull(), F.lit("stable"))
    )
