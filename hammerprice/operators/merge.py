"""Deduplication, upserts, merges of records and of their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str | Column], *order: str | Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def dedup_or(df: DataFrame, item: str, print_: str, *order: str) -> DataFrame:
    """First rows by item id, then by fingerprint among the survivors; a null or empty id or
    fingerprint has no double. The first row is an aggregate, so copies meet before the shuffle."""
    for key in (item, print_):
        known = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
        first = df.where(known).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
        df = first.select("_row.*").unionByName(df.where(~known))
    return df


def interleaved(df: DataFrame, kind: str, at: str, name: str) -> DataFrame:
    """``df`` with ``place``: one row of each kind in turn (kinds in order), each kind by ``at`` and
    ``name``, until all are placed. Ranks are counted within a kind and day and added up by
    counts, so that no kind is sorted in one task; kinds and days are few."""
    day = df.withColumn("_day", F.to_date(at))
    counts = day.groupBy(kind, "_day").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(kind)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(kind, "_day").orderBy(at, name))
    ranked = day.join(counts.select(kind, F.col("_day").alias("_d"), "_before").withColumnRenamed(kind, "_k"), F.col(kind).eqNullSafe(F.col("_k")) & F.col("_day").eqNullSafe(F.col("_d"))).withColumn("_r", rank + F.col("_before"))
    sizes = counts.groupBy(kind).agg(F.sum("_c").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), "n"))).alias("_sizes"))  # a row per kind
    ranked = ranked.crossJoin(F.broadcast(sizes))
    earlier = F.aggregate("_sizes", F.lit(0).cast("bigint"), lambda s, x: s + F.least(x["n"], F.col("_r") - 1))
    turn = F.aggregate("_sizes", F.lit(0).cast("bigint"), lambda s, x: s + ((x["k"] < F.col(kind)) & (x["n"] >= F.col("_r"))).cast("bigint"))
    return ranked.select(*df.columns, (earlier + turn + 1).alias("place"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge; incoming fields win unless null. ``is_new`` marks rows that were not there."""
    values = [c for c in current.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_there"))
    out = current.withColumn("_here", F.lit(True)).join(new, keys, "full_outer")
    return out.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in values], F.col("_here").isNull().alias("is_new"))


def merge_meta(df: DataFrame, key: str, latest: list[str] = (), earliest: list[str] = (), most: list[str] = (), first: list[str] = (), order: str | None = None) -> DataFrame:
    """One row per key: latest and largest values by max, earliest by min, others the first that is not null."""
    aggs = [F.max(c).alias(c) for c in [*latest, *most]] + [F.min(c).alias(c) for c in earliest]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return df.groupBy(key).agg(*aggs)


def numbered_duplicates(df: DataFrame, keys: list[str], *order: str, most: int = 50) -> DataFrame:
    """``df`` with ``lot``: 1, 2, ... within equal keys; rows beyond ``most`` have null."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("lot", F.when(nth <= most, nth))


def duplicate_groups(df: DataFrame, name: str, key: str, count: str) -> DataFrame:
    """Groups of two names or more with one canonical key: how many, empty ones, class, and the winner
    (its own key first, then most rows, shortest, alphabetically first)."""
    rank = F.struct((F.col(name) != F.col(key)).cast("int"), -F.col(count), F.length(name), F.col(name))
    empty = F.sum((F.col(count) == 0).cast("bigint"))
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("names"), empty.alias("empty"), F.max(count).alias("most"), (F.max(count) - F.min(count)).alias("delta"), F.min_by(name, rank).alias("winner"))
    kind = F.when(F.col("empty") == F.col("names"), "all-empty").when(F.col("empty") == 0, "all-populated").otherwise("mixed-populated-and-empty")
    return out.where("names > 1").withColumn("class", kind)


def merge_losers(df: DataFrame, name: str, key: str, count: str) -> DataFrame:
    """name, winner: every name of a group that goes, for a reversible archive."""
    rank = F.struct((F.col(name) != F.col(key)).cast("int"), -F.col(count), F.length(name), F.col(name))
    winners = df.groupBy(key).agg(F.min_by(name, rank).alias("winner"))
    return df.join(winners, key).where(F.col(name) != F.col("winner")).select(name, "winner", count)


def shrink_guard(current: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per group before and after, and whether the write would lose any."""
    before = current.groupBy(*keys).agg(F.count(F.lit(1)).alias("before"))
    after = merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("after"))
    out = before.join(after, keys, "full_outer").na.fill(0, ["before", "after"])
    return out.withColumn("refused", F.col("after") < F.col("before"))
