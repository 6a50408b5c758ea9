"""Robust grouped statistics, from counts by distinct value: rows are read once and summed
before the shuffle; windows and ranks only see distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import money

#: Width of the fence, and the factor from MAD to a standard deviation.
FENCE, MAD_TO_SIGMA = 3.5, 1.4826


def value_counts(df: DataFrame, keys: list[str], value: str, **sums: Column) -> DataFrame:
    """A row per group and distinct value: ``c`` (rows) and the named sums. Null values don't count.

    Everything else is told from this table, which grows with the distinct values, not the rows."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"), *[F.sum(x).alias(name) for name, x in sums.items()])


def _quantile(value: str, upto: str, share: float, group: Window) -> Column:
    """The interpolated quantile of a group from counts summed up to each value (n: rows)."""
    at = (F.col("n") - 1) * F.lit(share)
    below, above = F.floor(at), F.ceil(at)
    low, high = (F.min(F.when(F.col(upto) > x, F.col(value))).over(group) for x in (below, above))
    return F.when(below == above, low).otherwise((above - at) * low + (at - below) * high)


def with_spread(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counts`` (of ``value_counts``) with n, upto (rows up to the value), med and mad of their group."""
    w = Window.partitionBy(*keys)
    out = counts.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value)))
    out = out.withColumn("med", _quantile(value, "upto", 0.5, w)).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    out = out.withColumn("_near", F.sum("c").over(w.orderBy("_dev")))  # equal deviations are peers
    return out.withColumn("mad", _quantile("_dev", "_near", 0.5, w)).drop("_dev", "_near")


def inside_fence(value: str, k: float = FENCE) -> Column:
    """Within ``k`` robust standard deviations of the median; groups below four keep all."""
    spread = F.col("mad") * MAD_TO_SIGMA * k
    return (F.col("n") < 4) | F.col(value).between(F.col("med") - spread, F.col("med") + spread)


def mad_flag(df: DataFrame, keys: list[str], value: str, k: float = FENCE) -> DataFrame:
    """``df`` with med, mad, n of its group, and ``kept``: whether the value is inside the fence."""
    groups = with_spread(value_counts(df, keys, value), keys, value).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("med", "mad", "n")])
    return df.join(groups, keys).withColumn("kept", inside_fence(value, k))


def iqr_flag(df: DataFrame, keys: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """``df`` with ``kept`` by the quartile fence; quartiles are the values at index floor(n/4) and
    floor(3n/4). Ranks come from counts of equal values, summed before the window."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col(value)))

    fence = counts.groupBy(*keys).agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("n").alias("n"))
    reach = (F.col("q3") - F.col("q1")) * factor
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return df.join(fence, keys).withColumn("kept", (F.col("n") < 4) | inside)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``keys``, ``weighted_median``: the first value at which the running weight reaches half.

    A zero or missing weight counts as one. Weights should be decimals: their sums don't
    depend on the order. Equal values are summed before the window."""
    w = F.when(F.coalesce(F.col(weight), F.lit(0)) == 0, F.lit(1)).otherwise(F.col(weight))
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(w).alias("w"))
    group = Window.partitionBy(*keys)
    # Doubled before they are summed: a product of the widest decimals would lose digits.
    running = F.sum(F.col("w") + F.col("w")).over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("running", running).withColumn("total", F.sum("w").over(group))
    reached = F.col("running") >= F.col("total")
    return each.groupBy(*keys).agg(F.min(F.when(reached, F.col(value))).alias("weighted_median"))


def binned_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ``median`` (interpolated, exact) of groups that are too large for one task each.

    Values are counted by bins, which are summed before the shuffle; then only the values of the bins that
    hold the middle are ranked: one or two a group, which all tasks get. ``df`` is read twice."""
    v, of = F.col(value), Window.partitionBy(*keys)
    rows = df.where(v.isNotNull()).withColumn("_bin", F.floor(F.signum(v) * F.sqrt(F.abs(v))))
    bins = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("c"))
    bins = bins.withColumn("n", F.sum("c").over(of)).withColumn("_upto", F.sum("c").over(of.orderBy("_bin")))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    bins = bins.withColumn("_before", F.col("_upto") - F.col("c")).where((F.col("_upto") > low) & (F.col("_before") <= high)).drop("c", "_upto")
    each = rows.join(F.broadcast(bins), [*keys, "_bin"]).groupBy(*keys, "n", "_bin", "_before", value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("_before") + F.sum("c").over(Window.partitionBy(*keys, "_bin").orderBy(value))
    each = each.withColumn("_upto", upto)
    below, above = (F.min(F.when(F.col("_upto") > x, v)) for x in (low, high))
    return each.groupBy(*keys).agg((below * 0.5 + above * 0.5).alias("median"))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, median, p25, p75, min, max, stddev (0 for one row) and mad, as money."""
    w, v, c = Window.partitionBy(*keys), F.col(value), F.col("c")
    out = with_spread(value_counts(df, keys, value), keys, value).withColumn("_mean", F.sum(v * c).over(w) / F.col("n"))
    out = out.withColumn("_p25", _quantile(value, "upto", 0.25, w)).withColumn("_p75", _quantile(value, "upto", 0.75, w))
    spread = F.when(F.max("n") > 1, F.sqrt(F.sum(c * (v - F.col("_mean")) * (v - F.col("_mean"))) / (F.max("n") - 1))).otherwise(0.0)
    stats = {"mean": F.max("_mean"), "median": F.max("med"), "p25": F.max("_p25"), "p75": F.max("_p75"), "min": F.min(v), "max": F.max(v), "stddev": spread, "mad": F.max("mad")}
    return out.groupBy(*keys).agg(F.max("n").alias("count"), *[money(x).alias(name) for name, x in stats.items()])


def fair_values(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """``keys``, fair_value (weighted median inside the fence), n, low, high and removed (rows
    outside): one pass over ``df``, the rest from counts by value. Weights are decimals above zero."""
    w, v = Window.partitionBy(*keys), F.col(value)
    out = with_spread(value_counts(df, keys, value, w=weight), keys, value).withColumn("kept", inside_fence(value))
    own = F.when(F.col("kept"), F.col("w"))
    out = out.withColumn("_running", F.sum(own + own).over(w.orderBy(value))).withColumn("_total", F.sum(own).over(w))
    fair = F.min(F.when(F.col("kept") & (F.col("_running") >= F.col("_total")), v))
    rows = F.coalesce(F.sum(F.when(F.col("kept"), F.col("c"))), F.lit(0))
    inside = F.when(F.col("kept"), v)
    return out.groupBy(*keys).agg(fair.alias("fair_value"), rows.alias("n"), F.min(inside).alias("low"), F.max(inside).alias("high"), (F.sum("c") - rows).alias("removed"))


def recency_weight(sold: Column, as_of: Column, half_life: Column | float, score: Column | None = None) -> Column:
    """1 / (1 + days / half-life) times score / 100, as decimal(18, 9); a day at least, 30 without a date, 50 without a score."""
    days = F.coalesce(F.greatest(F.lit(1.0), (F.unix_millis(as_of) - F.unix_millis(sold)) / 86_400_000.0), F.lit(30.0))
    half = F.lit(float(half_life)) if isinstance(half_life, (int, float)) else half_life
    share = F.lit(1.0) if score is None else F.when(F.coalesce(score, F.lit(0)) == 0, F.lit(50)).otherwise(score) / 100.0
    return (share / (1 + days / half)).cast("decimal(18,9)")
