"""JSON stores of unknown shape: one object for a whole store, its keys data, nested to any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walked(df: DataFrame, text: str, levels: list[str], value: str) -> DataFrame:
    """A row for each leaf of the objects in ``text``: the other columns of ``df``, a column of keys for each of ``levels``, and
    ``value``, a variant. What is no JSON, or no object on the way, has no leaves; schemas need not be known."""
    out = df.withColumn(value, F.try_parse_json(text)).drop(text)
    for level in levels:
        # A level is an object only: the elements of an array have no keys.
        inner = out.where(F.schema_of_variant(value).startswith("OBJECT<"))
        kept = [c for c in inner.columns if c != value]
        out = inner.withColumnRenamed(value, "_whole").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_whole").outer()).select(F.col("key").alias(level), F.col("value").alias(value)))
        out = out.select(*kept, level, value)
    return out


def catalogue(entries: DataFrame, least: int = 100) -> DataFrame:
    """``number, category, year`` of each catalogue number above ``least``: where it was seen first.

    ``entries``: nth (order of the stores), category, kind, year, mint and number (a variant), as a walk
    over category, table, year and mint gives them. Keys that are no years and leaves that are
    no whole numbers are passed over; within a store keys go by the alphabet."""
    number = F.try_variant_get("number", "$", "bigint")
    rows = entries.select("nth", "category", "kind", F.col("year").try_cast("int").alias("year"), "mint", number.alias("number"))
    seen = rows.where((F.col("number") > least) & F.col("year").isNotNull())
    return seen.groupBy("number").agg(F.min_by(F.struct("category", "year"), F.struct("nth", "category", "kind", "year", "mint")).alias("_first")).select("number", "_first.*")


def as_store(meta: DataFrame) -> DataFrame:
    """``key, search_term, comps`` of a sidecar of metadata (key, search_term, comp_count): what a classifier that
    looks at the number of comps alone needs."""
    return meta.select("key", "search_term", F.coalesce("comp_count", F.lit(0)).alias("comps"))
