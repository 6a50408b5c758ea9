"""Running totals, quotas and medians over one order of all rows, without one task for all rows.

Rows are range-sorted, so partitions follow each other in the order; each is summed by
itself, and what stands before a partition is a number that is joined to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import staged


def prefix_sums(df: DataFrame, order: list[Column | str], amount: Column) -> DataFrame:
    """``df`` with ``place`` (from 1) and ``total``, the sum of ``amount`` up to and with the row, in ``order``.

    Null amounts count as zero. Rows that the order can't tell apart stand in one partition,
    in any order; name enough columns. Nulls come first where the order is rising."""
    own = df.withColumn("_amount", F.coalesce(amount, F.lit(0)))
    ranged = staged(own.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(F.sum("_amount").alias("_sum"), F.count(F.lit(1)).alias("_rows")).collect()  # a row for each partition
    before, seen, rows = [], None, 0
    for r in sorted(sums):
        before.append((r["_part"], seen, rows))
        seen, rows = r["_sum"] if seen is None else seen + r["_sum"], rows + r["_rows"]
    kind = ranged.groupBy().agg(F.sum("_amount").alias("s")).schema["s"].dataType.simpleString()
    offsets = df.sparkSession.createDataFrame(before, f"_part int, _before {kind}, _seen bigint")
    w = Window.partitionBy("_part").orderBy(*order)
    running = F.sum("_amount").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumns({"_running": running, "_nth": F.row_number().over(w)}).join(F.broadcast(offsets), "_part")
    total = F.when(F.col("_before").isNull(), F.col("_running")).otherwise(F.col("_running") + F.col("_before"))
    return out.select(*df.columns, (F.col("_nth") + F.col("_seen")).alias("place"), total.alias("total"))


def take_while(df: DataFrame, order: list[Column | str], amount: Column, budget) -> DataFrame:
    """The rows from the first one on whose running total fits into ``budget``; what comes after a row
    that doesn't fit is left, even if it would. Amounts are not negative."""
    return prefix_sums(df, order, amount).where(F.col("total") <= F.lit(budget))


def mixed_quota(df: DataFrame, first: Column, order: list[Column | str], fixed: int, extra: int) -> DataFrame:
    """``fixed`` rows for which ``first`` holds and ``extra`` others, in order; what the first lack the others fill up."""
    flag = F.coalesce(first, F.lit(False))
    some = prefix_sums(df.where(flag), order, F.lit(1)).where(F.col("place") <= fixed)
    ours = some.count()
    rest = prefix_sums(df.where(~flag), order, F.lit(1)).where(F.col("place") <= fixed + extra - ours)
    return some.unionByName(rest).drop("place", "total")


def upper_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and ``upper_median``: of 2n values the (n + 1)-th. From counts by distinct value; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if not keys:
        all_ = prefix_sums(counts, [value], F.col("_n"))
        half = F.lit(counts.agg(F.sum("_n")).first()[0])
        return all_.agg(F.min(F.when(F.col("total") > F.floor(half / 2), F.col(value))).alias("upper_median"))
    w = Window.partitionBy(*keys)
    running = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_run": running, "_all": F.sum("_n").over(w)})
    return ranked.where(F.col("_run") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias("upper_median"))


def word_set(name: Column) -> Column:
    """The distinct words of a key or a file's name, sorted: equal for names that differ in order, case, dashes and underscores."""
    plain = F.translate(F.lower(F.regexp_replace(name, r"\.csv$", "")), "-_", "  ")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))), " ")


def file_name(term: Column) -> Column:
    """A safe file name for a search: letters, digits, dashes and underscores, 80 characters at most."""
    return F.concat(F.substring(F.replace(F.regexp_replace(term, r"[^\w\s\-]", ""), F.lit(" "), F.lit("_")), 1, 80), F.lit(".csv"))


def backlog(datasets: DataFrame, files: DataFrame, priorities: list[str], include: list[str] | None = None, exclude: list[str] = (), carried: list[str] = ()) -> DataFrame:
    """``key, file, is_new`` and the columns ``carried`` of the data sets to refresh.

    ``datasets``: key, search_term, actions, priority; ``files``: file. Dormant ones go, then
    those outside ``include`` or inside ``exclude``; then one of ``priorities`` is needed, or, where
    none is given, an action ``refresh-page1`` or ``needs-data``. A data set's file is the last in
    the alphabet with its words; without one it is new, under its search term's name."""
    p = F.col("priority")
    wanted = F.coalesce(p.isin(*priorities), F.lit(False)) | p.isNull() & F.arrays_overlap("actions", F.array(F.lit("refresh-page1"), F.lit("needs-data")))
    rows = datasets.where(~F.coalesce(F.array_contains("actions", "dormant"), F.lit(False)))
    if include is not None:
        rows = rows.where(F.coalesce(p.isin(*include), F.lit(False)))
    if exclude:
        rows = rows.where(~F.coalesce(p.isin(*exclude), F.lit(False)))
    named = files.groupBy(word_set(F.col("file")).alias("_words")).agg(F.max("file").alias("file"))
    out = rows.where(wanted).withColumn("_words", word_set(F.col("key"))).join(named, "_words", "left")
    return out.select(*carried, "key", F.coalesce("file", file_name(F.coalesce("search_term", "key"))).alias("file"), F.col("file").isNull().alias("is_new"))
