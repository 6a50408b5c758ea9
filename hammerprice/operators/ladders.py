"""Look-ups that go down a ladder: the first step that finds something counts.

Steps by key are equi-joins of candidate keys; steps by likeness of names go through the
gram index of ``dictionary``, once for each distinct name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionary

#: How fractions and multiples of an ounce are named in a series.
SIZES = [(0.5, "1/2 oz"), (0.25, "1/4 oz"), (0.1, "1/10 oz"), (0.05, "1/20 oz"), (1.5, "1.5 oz"), (2.0, "2 oz"), (5.0, "5 oz"), (10.0, "10 oz")]


def series_names(items: DataFrame, series: DataFrame) -> DataFrame:
    """``name, series, step`` for each distinct name that means a series.

    Steps: equal to the series (0), equal to an alias (1), an alias inside the name (2), name or
    series inside the other (3). Ties go to the longest series, then the first in the alphabet.
    ``series`` has series and aliases (an array); names are trimmed and compared in lower case."""
    own = items.select("name", F.lower(F.trim("name")).alias("_n")).where("_n != ''").distinct()
    dim = series.select("series", F.lower("series").alias("_s"))
    aliases = series.select("series", F.explode("aliases").alias("_a")).withColumn("_a", F.lower("_a"))
    short = own.select("_n").distinct()

    def step(found: DataFrame, nth: int) -> DataFrame:
        return found.select("_n", "series", F.lit(nth).alias("step"))

    steps = step(short.join(dim, F.col("_n") == F.col("_s")), 0).union(step(short.join(aliases, F.col("_n") == F.col("_a")), 1))
    steps = steps.union(step(dictionary.held_names(short, aliases, "_n", "_a").join(aliases, "_a"), 2))
    steps = steps.union(step(dictionary.either_way(short, dim, "_n", "_s").join(dim, "_s"), 3))
    best = steps.groupBy("_n").agg(F.min_by("series", F.struct("step", -F.length("series"), "series")).alias("series"), F.min("step").alias("step"))
    return own.join(best, "_n").select("name", "series", "step")


def key_dates(items: DataFrame, dates: DataFrame) -> DataFrame:
    """``items`` (series, year, mint, ...) with ``tier`` and ``step`` of the key date that they are, null for none.

    ``dates`` has nth, series, year (0: any), mint (``*``: any) and tier. Steps: the date itself (0),
    any mint of the year (1), any year of the series (2), and the first date whose series holds
    the item's or is held by it, under the same wild cards (3). A null mint is an empty one."""
    low = {"_s": F.lower(F.trim("series")), "_y": F.coalesce("year", F.lit(-1)), "_m": F.lower(F.trim(F.coalesce("mint", F.lit(""))))}
    own = items.withColumns(low)
    dim = dates.select("nth", F.lower(F.trim("series")).alias("_ds"), F.col("year").alias("_dy"), F.lower(F.trim("mint")).alias("_dm"), "tier")
    asked = own.select("_s", "_y", "_m").where("_s != ''").distinct()
    keys = F.array(F.struct(F.col("_y").alias("_dy"), F.col("_m").alias("_dm")), F.struct(F.col("_y").alias("_dy"), F.lit("*").alias("_dm")), F.struct(F.lit(0).alias("_dy"), F.lit("*").alias("_dm")))
    exact = asked.select("*", F.posexplode(keys).alias("step", "_k")).select("_s", "_y", "_m", "step", F.col("_s").alias("_ds"), "_k.*").join(dim, ["_ds", "_dy", "_dm"])
    alike = dictionary.either_way(asked, dim, "_s", "_ds")
    wild = asked.join(alike, "_s").join(dim, "_ds").where("(_dy = 0 OR _dy = _y) AND (_dm = '*' OR _dm = _m)").withColumn("step", F.lit(3))
    steps = exact.select("_s", "_y", "_m", "step", "nth", "tier").union(wild.select("_s", "_y", "_m", "step", "nth", "tier"))
    best = steps.groupBy("_s", "_y", "_m").agg(F.min_by(F.struct("tier", "step"), F.struct("step", "nth")).alias("_best"))
    return own.join(best, ["_s", "_y", "_m"], "left").select(*items.columns, "_best.tier", "_best.step")


def mintages(items: DataFrame, mints: DataFrame) -> DataFrame:
    """``items`` (series, year, mint, weight, finish, ...) with ``mintage`` and ``found_in``, the series whose table has it.

    ``mints`` has series (in lower case), year, mint, mintage and nth, the order within a
    table. A proof is looked for among proofs alone (``<series> proof``): its mint, Philadelphia
    where no mint is named, any mint of the year. Else the table of a fraction goes before the
    series' own; a missing mint means Philadelphia."""
    given = F.nullif(F.upper(F.trim("mint")), F.lit(""))
    proof = F.coalesce(F.lower("finish").contains("proof"), F.lit(False))
    size = F.when(F.lit(False), "")
    for weight, name in SIZES:
        size = size.when(F.col("weight") == weight, name)
    own = items.withColumns({"_s": F.lower(F.trim("series")), "_m": F.coalesce(given, F.lit("P")), "_p": proof, "_z": size})

    def key(series: Column, mint: Column, when: Column) -> Column:
        return F.when(when & series.isNotNull(), F.struct(series.alias("_ts"), mint.alias("_tm")))

    struck, sized = F.concat("_s", F.lit(" proof")), F.concat_ws(" ", "_s", "_z")
    ladder = F.array(key(struck, F.col("_m"), F.col("_p")), key(struck, F.lit("*"), F.col("_p")), key(sized, F.col("_m"), ~F.col("_p") & F.col("_z").isNotNull()), key(F.col("_s"), F.col("_m"), ~F.col("_p")))
    asked = own.select("_s", "year", "_m", "_p", "_z").distinct()
    steps = asked.select("*", F.posexplode(ladder).alias("_nth", "_k")).where("_k IS NOT NULL").select("_s", "year", "_m", "_p", "_z", "_nth", "_k.*")
    some = mints.groupBy("series", "year").agg(F.min_by("mintage", "nth").alias("mintage")).withColumn("mint", F.lit("*"))
    dim = mints.select("series", "year", "mint", "mintage").unionByName(some).withColumnsRenamed({"series": "_ts", "mint": "_tm"})
    best = steps.join(dim.where("mintage IS NOT NULL"), ["_ts", "year", "_tm"]).groupBy("_s", "year", "_m", "_p", "_z").agg(F.min_by(F.struct("mintage", F.col("_ts").alias("found_in")), "_nth").alias("_best"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_s", "year", "_m", "_p", "_z")]
    out = own.alias("a").join(best.alias("b"), same, "left")
    return out.select(*[F.col(f"a.{c}") for c in items.columns], F.col("b._best.mintage").alias("mintage"), F.col("b._best.found_in").alias("found_in"))


def first_table(items: DataFrame, rules: list[tuple[str, list[str]]], numbers: DataFrame) -> DataFrame:
    """``items`` (series, year, mint, ...) with ``number`` and ``listed_in``: of the tables of all rules whose
    pattern the series holds, in order, the first that has the year; there the mint's number, else
    Philadelphia's, else the first. ``numbers`` has listed_in, year, mint, number, nth."""
    tables = F.flatten(F.array(*[F.when(F.lower("series").rlike(p), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for p, names in rules]))
    own = items.withColumns({"_s": F.lower("series"), "_m": F.coalesce(F.nullif(F.upper("mint"), F.lit("")), F.lit("P"))})
    asked = own.select("_s", "series", "year", "_m").distinct().select("_s", "year", "_m", F.posexplode(tables).alias("_nth", "listed_in")).distinct()
    rank = F.when(F.col("mint") == F.col("_m"), 0).when(F.col("mint") == "P", 1).otherwise(2)
    met = asked.join(numbers.where("number IS NOT NULL"), ["listed_in", "year"])
    best = met.groupBy("_s", "year", "_m").agg(F.min_by(F.struct("number", "listed_in"), F.struct("_nth", rank, "nth")).alias("_best"))
    return own.join(best, ["_s", "year", "_m"], "left").select(*items.columns, "_best.number", "_best.listed_in")
