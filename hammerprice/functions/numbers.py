"""Rounding, defaults and fixed ladders over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    """Two decimals, halves up: floor(100 x + 0.5) / 100. Null stays null."""
    return F.floor(x * 100 + 0.5) / 100.0


def whole(x: Column) -> Column:
    """The nearest whole number, halves up."""
    return F.floor(x + 0.5)


def or_default(x: Column, default: Column) -> Column:
    """``x`` unless it is null, zero or not a number."""
    return F.when(x.isNull() | F.isnan(x.cast("double")) | (x == 0), default).otherwise(x)


def ladder(x: Column, steps: list[tuple[float, object]], beyond: object) -> Column:
    """The value of the first step whose bound is not below ``x``; null stays null."""
    out = F.when(x.isNull(), F.lit(None))
    for bound, value in steps:
        out = out.when(x <= bound, F.lit(value))
    return out.otherwise(F.lit(beyond))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def blend(sources: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the sources that are there, weights renormalised over them;
    plain mean if all those weights are zero, null without a source."""
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in sources), F.lit(0.0))
    known = sum((v.isNotNull().cast("int") for v, _ in sources), F.lit(0))
    weighted = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in sources), F.lit(0.0))
    plain = sum((F.coalesce(v, F.lit(0.0)) for v, _ in sources), F.lit(0.0))
    return F.when(known == 0, F.lit(None)).when(total > 0, weighted / total).otherwise(plain / known)


#: Mintage bounds and their names.
RARITY = [(5, "Unique"), (25, "Extremely Rare"), (100, "Very Rare"), (1_000, "Rare"), (10_000, "Scarce"), (100_000, "Semi-Scarce"), (1_000_000, "Common")]


def rarity(mintage: Column) -> Column:
    """One of eight names by mintage; null for unknown or negative numbers."""
    return F.when(mintage >= 0, ladder(mintage, RARITY, "Very Common"))
