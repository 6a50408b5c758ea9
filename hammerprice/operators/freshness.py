"""How fresh a dataset is, how deep its market, and what to do about it.

Input columns: comp_count, newest_sale, last_refresh, no_data_at (timestamps), no_data_count,
refresh_count, last_new, dry (consecutive dry refreshes), file_exists; missing counts are zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in days unless named otherwise.
STALE, VERY_STALE, THIN_ROWS, CONFIRMED_REFRESHES = 15, 30, 10, 3
THIN_CADENCE, CONFIRMED_CADENCE, RECENT, DORMANT_COUNT, DORMANT_WINDOW = 60, 90, 14, 2, 60
#: Consecutive dry refreshes, and the days to wait then.
DRY = [(4, 60), (2, 30)]


def days_since(t: Column, as_of: Column) -> Column:
    """Whole days of 24 hours."""
    return F.floor((F.unix_millis(as_of) - F.unix_millis(t)) / 86_400_000)


def classified(df: DataFrame, as_of: Column) -> DataFrame:
    """``df`` with freshness, depth, dormant, skip_reason, action, priority and the ages they rest on."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("comp_count", "refresh_count", "no_data_count", "dry")}
    n = zero["comp_count"]
    there = F.coalesce("file_exists", F.lit(False))
    plausible = F.when(F.unix_millis("last_refresh") <= F.unix_millis(as_of) + 300_000, F.col("last_refresh"))
    out = df.withColumns({"stale_days": days_since(F.col("newest_sale"), as_of), "refresh_days": days_since(plausible, as_of), "no_data_days": days_since(F.col("no_data_at"), as_of)})
    age, wait = F.col("stale_days"), F.col("refresh_days")
    fresh = F.when((n == 0) & F.col("newest_sale").isNull(), F.when(there, "stale").otherwise("missing"))
    fresh = fresh.when(age >= VERY_STALE, "very-stale").when(age >= STALE, "stale").when(age.isNotNull(), "fresh").otherwise("stale")
    confirmed = (zero["refresh_count"] >= CONFIRMED_REFRESHES) | (zero["refresh_count"] >= 1) & F.coalesce(F.col("last_new") == 0, F.lit(False))
    depth = F.when((n == 0) & ~there & (zero["refresh_count"] == 0), "untested").when(n == 0, "empty").when((n < THIN_ROWS) & confirmed, "confirmed-thin").when(n < THIN_ROWS, "thin").otherwise("viable")
    dormant = (zero["no_data_count"] >= DORMANT_COUNT) & F.coalesce(F.col("no_data_days") < DORMANT_WINDOW, F.lit(False))
    out = out.withColumns({"freshness": fresh, "depth": depth, "dormant": dormant})
    f, d = F.col("freshness"), F.col("depth")
    old = (d == "viable") & f.isin("stale", "very-stale")
    backoff = F.lit(False)
    for dry, days in DRY:
        backoff |= (zero["dry"] >= dry) & (wait < days)
    reason = F.when(F.col("dormant"), "dormant").when(d == "empty", "empty")
    reason = reason.when((d == "confirmed-thin") & (wait < CONFIRMED_CADENCE), "confirmed-thin-skip").when((d == "thin") & (wait < THIN_CADENCE), "thin-wait")
    reason = reason.when(old & backoff, "dry-refresh-backoff").when(old & (wait < RECENT), "recently-confirmed-stale")
    out = out.withColumn("skip_reason", reason)
    action = F.when(F.col("dormant") | (d == "empty"), "dormant").when((f == "missing") & (d == "untested"), "initial-fetch")
    # A confirmed thin market without any refresh time waits, unlike a merely thin one.
    action = action.when((d == "confirmed-thin") & F.coalesce(wait >= CONFIRMED_CADENCE, F.lit(False)), "monitor-refresh").when(d == "confirmed-thin", "confirmed-thin-skip")
    action = action.when(F.col("skip_reason").isNotNull(), F.col("skip_reason")).when(d == "thin", "monitor-refresh").when(old, "refresh").otherwise("ok")
    out = out.withColumn("action", action)
    a = F.col("action")
    rank = F.when(a == "initial-fetch", "P2").when(a == "monitor-refresh", "P3").when((a == "refresh") & (f == "very-stale"), "P0").when(a == "refresh", "P1")
    return out.withColumn("priority", rank)


def refresh_queue(df: DataFrame, name: str, n: int) -> DataFrame:
    """The ``n`` most urgent datasets: by priority, then the stalest, unknown ages first."""
    return df.where("priority is not null").orderBy("priority", F.desc_nulls_first("stale_days"), name).limit(n)


def _old(days: int) -> Column:
    return F.col("newest_sale").isNull() | (F.col("stale_days") >= days)


def skip_counts(df: DataFrame, days: int = STALE) -> DataFrame:
    """reason (``actionable`` for none), n and stale (older than ``days`` or without sales) of ``classified`` data sets."""
    return df.groupBy(F.coalesce("skip_reason", F.lit("actionable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(_old(days)).alias("stale"))


def stale_pattern(df: DataFrame, term: str, name: str, days: int = VERY_STALE, limit: int = 50) -> DataFrame:
    """n and pattern: the ``limit`` stalest of the ``classified`` data sets that nothing speaks against, their terms as
    one regular expression of whole names, stalest first; an empty one for none. Only those few rows are gathered."""
    top = df.where(F.col("skip_reason").isNull() & _old(days)).orderBy(F.desc_nulls_first("stale_days"), name).limit(limit)
    quoted = F.concat(F.lit("^"), F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit("$"))
    order = F.struct(F.col("stale_days").isNotNull(), -F.col("stale_days"), F.col(name), quoted.alias("quoted"))
    found = top.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(order)).alias("all"))
    return found.select("n", F.array_join(F.transform("all", lambda x: x["quoted"]), "|").alias("pattern"))
