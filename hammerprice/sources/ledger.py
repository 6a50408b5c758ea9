"""Incremental import of a folder of listing files: a ledger says what was read, and when.

The folder's listing is compared with the ledger; files that are new, changed, grown or old
are read and replace their own rows, all others are left alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, listings
from .versions import Store

LEDGER = "path string, size bigint, modified timestamp, rows bigint, first_sold timestamp, last_sold timestamp, page1_at timestamp, deep_at timestamp, imported_at timestamp"
#: A first page holds so many rows; files with more were read on.
PAGE = 50


def verdicts(listing: DataFrame, ledger: DataFrame, as_of: Column, age: str = "7 days", growth: float = 0.10) -> DataFrame:
    """``path, size, modified, action`` of every file that is there or was read.

    Actions: ``new``; ``stale``, read longer than ``age`` ago; ``modified`` since; ``grown`` by more
    than ``growth`` although its time says nothing of it; ``fresh``; ``vanished``."""
    old = ledger.select("path", F.col("size").alias("_size"), "imported_at")
    both = listing.join(old, "path", "full_outer")
    action = F.when(F.col("size").isNull(), "vanished").when(F.col("imported_at").isNull(), "new")
    action = action.when(F.col("imported_at") + F.expr(f"INTERVAL {age}") <= as_of, "stale").when(F.col("modified") > F.col("imported_at"), "modified")
    action = action.when(F.col("size") > F.col("_size") * (1 + growth), "grown").otherwise("fresh")
    return both.select("path", "size", "modified", action.alias("action"))


def bounds(rows: DataFrame, when: str) -> DataFrame:
    """``path, rows, first_sold, last_sold`` of each file of ``rows`` (_file, when): one row a file."""
    return rows.groupBy(F.col("_file").alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.min(when).alias("first_sold"), F.max(when).alias("last_sold"))


def entries(due: DataFrame, found: DataFrame, imported_at: Column) -> DataFrame:
    """Ledger rows of the files ``due``, those without rows among them: a first page was read when the
    file was last written, and was read on if it has more rows than a page."""
    out = due.select("path", "size", "modified").join(found, "path", "left").na.fill(0, ["rows"])
    deep = F.when(F.col("rows") > PAGE, F.col("modified"))
    return out.select("path", "size", "modified", "rows", "first_sold", "last_sold", F.when(F.col("rows") > 0, F.col("modified")).alias("page1_at"), deep.alias("deep_at"), imported_at.alias("imported_at"))


def import_folder(spark: SparkSession, folder: str, store: Store, ledger: Store, as_of: dt.datetime, age: str = "7 days", force: bool = False, only: list[str] | None = None) -> DataFrame:
    """Brings the listings of ``folder`` into ``store`` (keyed by ``_file``) and returns the verdict on each file.

    ``only`` names the files to look at; ``force`` reads all that are there. Vanished files
    keep their rows. Names of due files pass the driver, as those of any read do."""
    known = ledger.read() if ledger.version() else spark.createDataFrame([], LEDGER)
    listing = files.listed(spark, folder)
    if only is not None:
        listing = listing.where(F.regexp_extract("path", "([^/]+)$", 1).isin(only))
        known = known.where(F.regexp_extract("path", "([^/]+)$", 1).isin(only))
    now = F.lit(as_of).cast("timestamp")
    seen = verdicts(listing, known, now, age)
    verdict = [tuple(r) for r in seen.collect()]
    judged = spark.createDataFrame(verdict, "path string, size bigint, modified timestamp, action string")
    due = [path for path, _, _, action in verdict if action != "vanished" and (force or action != "fresh")]
    if due:
        asked = judged.where(F.col("path").isin(due))
        for separator, ends in ((",", (".csv", ".txt")), ("\t", (".tsv",))):
            own = [p for p in due if p.lower().endswith(ends)]
            if own:
                rows = listings.listings(spark, own, separator).drop("_row")
                rows = rows.withColumn("_file", F.url_decode("_file"))
                store.replace(rows)
        there = store.read().where(F.col("_file").isin(due)) if store.version() else spark.createDataFrame([], "_file string, sold_date timestamp")
        ledger.replace(entries(asked, bounds(there, "sold_date"), now))
    return judged
