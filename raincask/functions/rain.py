"""Rain categories, warnings, forcing scores, effect sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the rain categories in mm a day, and the verification thresholds.
CATEGORIES = [(0.0, "no rain"), (0.1, "very light"), (2.5, "light"), (15.6, "moderate"), (64.5, "heavy"), (115.6, "very heavy"), (204.5, "extremely heavy")]
THRESHOLDS = (2.5, 15.6, 64.5, 115.6, 204.5)
HEADS = (64.5, 115.6)
SEVERITY = ("red", "orange", "yellow", "green")


def category(mm: Column) -> Column:
    out = F.lit(CATEGORIES[0][1])
    for low, name in CATEGORIES[1:]:
        out = F.when(mm >= low, name).otherwise(out)
    return out


def warning(most: Column, p_heavy: Column, p_very: Column) -> Column:
    return F.when((most >= 204.5) | (p_very >= 0.5), "red").when((most >= 115.6) | (p_heavy >= 0.5) | (p_very >= 0.25), "orange").when((most >= 64.5) | (p_heavy >= 0.2), "yellow").otherwise("green")


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def upslope_score(flow: Column) -> Column:
    return clip(flow / 0.12)


def coastal_score(onshore: Column, distance_km: Column) -> Column:
    return clip(onshore / 8.0) * F.exp(-distance_km / 150.0) * F.when(distance_km > 0, 1.0).otherwise(0.0)


def convective_score(cape: Column, water: Column) -> Column:
    return clip(cape / 2500.0) * clip(water / 60.0)


def season_phase(date: Column) -> tuple[Column, Column]:
    turn = 2 * 3.141592653589793 * F.dayofyear(date) / 365.25
    return F.sin(turn), F.cos(turn)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def hedges_g(n1: Column, mean1: Column, var1: Column, n2: Column, mean2: Column, var2: Column) -> Column:
    """Standardised mean difference with the small-sample correction."""
    df = n1 + n2 - 2
    pooled = ((n1 - 1) * var1 + (n2 - 1) * var2) / F.nullif(df.cast("double"), F.lit(0.0))
    return (mean1 - mean2) / F.nullif(F.sqrt(pooled), F.lit(0.0)) * (1 - 3 / (4 * df - 1))


def system_class(depth: Column, vorticity: Column, wind: Column) -> Column:
    return F.when((depth >= 4.0) & (vorticity >= 2.0) & (wind >= 8.7), 2).otherwise(1)


def primary_regime(synoptic: Column, upslope: Column, coastal: Column, state: Column) -> Column:
    """0 system, 1 orographic, 2 coastal, 3 active, 4 normal, 5 break: the first that applies."""
    return F.when(synoptic > 0, 0).when(upslope >= 0.5, 1).when(coastal >= 0.5, 2).when(state == 1, 3).when(state == -1, 5).otherwise(4)
