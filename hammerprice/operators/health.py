"""Findings about valuations: what is wrong with a value, which checks of a bar fail, which searches are unstable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comps below which a value is thin; rows lost to filters, in per cent; spread of equal searches.
THIN, ATTRITION, HIGH_ATTRITION, SPREAD = 5, 70, 90, 0.05
#: Tolerance of a weight in ounces, grams to an ounce, and the share of the melt value that is the least.
WEIGHT_TOLERANCE, GRAMS, MELT_FLOOR = 0.001, 31.1035, 0.9


def findings(error: Column, value: Column, low_data: Column, comps: Column, attrition: Column, melt: Column, low: Column, high: Column) -> Column:
    """An array of ``severity:type`` for a valuation; empty if nothing is wrong. An error or a missing value stands
    alone; nulls of the other inputs find nothing. ``low`` and ``high`` bound the premium over ``melt``."""
    premium = F.when(melt > 0, value / melt - 1)
    soft = F.array_compact(F.array(
        F.when(low_data, "YELLOW:low-data"), F.when(comps < THIN, "YELLOW:thin-comps"), F.when(attrition > HIGH_ATTRITION, "RED:high-attrition").when(attrition > ATTRITION, "YELLOW:attrition"),
        F.when(premium < low, "YELLOW:premium-low").when(premium > high, "YELLOW:premium-high"),
    ))
    return F.when(error.isNotNull(), F.array(F.lit("RED:request-error"))).when(value.isNull(), F.array(F.lit("RED:no-fmv"))).otherwise(soft)


def rating(found: Column) -> Column:
    """RED, YELLOW or GREEN: the worst of ``findings``."""
    red = F.exists(found, lambda x: x.startswith("RED"))
    return F.when(red, "RED").when(F.size(found) > 0, "YELLOW").otherwise("GREEN")


def failed_checks(weight: Column, grams: Column, value: Column, low: Column, high: Column, melt: Column, comps: Column) -> Column:
    """The names of the checks of a bar that fail. A missing weight or value fails, a missing melt value checks nothing."""
    off = weight.isNull() | (F.abs(weight - grams / GRAMS) > WEIGHT_TOLERANCE)
    outside = value.isNull() | (value < low) | (value > high)
    return F.array_compact(F.array(F.when(off, "weight"), F.when(outside, "range"), F.when(value < melt * MELT_FLOOR, "melt"), F.when(F.coalesce(comps, F.lit(0)) == 0, "comps")))


def unstable(rows: DataFrame, term: str, value: str) -> DataFrame:
    """term, n, low, high and delta (per cent of the highest) of searches valued twice or more whose values
    are over five per cent apart. Bounds are enough, so no group is gathered."""
    groups = rows.groupBy(term).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).where("n > 1 AND high > 0")
    spread = (F.col("high") - F.col("low")) / F.col("high")
    return groups.where(spread > SPREAD).withColumn("delta", F.floor(spread * 10000 + 0.5) / 100)
