"""Tables of holdings and of dimension rows: priority look-ups and changes as whole-table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority_lookup(df: DataFrame, row: list[str], dim: DataFrame, key: str, candidates: list[Column], outputs: list[str]) -> DataFrame:
    """``df`` with the outputs of the first of its candidate keys that ``dim`` (key, outputs) has.

    Candidates go from the most to the least specific; null ones are passed over. ``row``
    names a row of ``df``."""
    each = df.select(*row, F.posexplode(F.array(*candidates)).alias("_nth", key)).where(F.col(key).isNotNull())
    found = each.join(dim.select(key, *outputs), key).groupBy(*row).agg(F.min_by(F.struct(*outputs), "_nth").alias("_out"))
    return df.join(found, row, "left").select(*df.columns, *[F.col(f"_out.{o}").alias(o) for o in outputs])


def item_hash(*fields: Column) -> Column:
    """SHA-256 of fields, trimmed, lower-cased, by bars; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.lower(F.trim(f.cast("string"))), F.lit("")) for f in fields]), 256)


def without(holdings: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return holdings.join(gone.select(*keys).distinct(), keys, "left_anti")


def changed(holdings: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (1 at least) and costs (0 or more, else as before) as ``changes`` (keys, count, cost) has them."""
    c = changes.select(*keys, F.col("count").alias("_count"), F.col("cost").alias("_cost"), F.lit(True).alias("_there"))
    out = holdings.join(c, keys, "left")
    count = F.when(F.col("_count").isNotNull(), F.greatest(F.lit(1), F.col("_count"))).otherwise(F.col("count"))
    cost = F.when(F.col("_cost") >= 0, F.col("_cost")).otherwise(F.col("cost"))
    return out.select(*[count.alias(x) if x == "count" else cost.alias(x) if x == "cost" else F.col(x) for x in holdings.columns])


def patched(meta: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Each field of the patch that is not null replaces the table's; unknown keys become new rows."""
    fields = [c for c in meta.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return meta.join(p, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in fields])
