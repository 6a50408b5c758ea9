"""Market panels: the matrix of every wanted series in one plan, from search words to cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import money
from ..stages import staged
from . import classes, ladders, market, robust, variants

#: Adjectives and the countries that searches name instead.
DEMONYMS = {"Mexican": "Mexico", "Canadian": "Canada", "Australian": "Australia", "Austrian": "Austria", "British": "Great Britain", "Chinese": "China"}
#: What makes a series a lunar one, and the first years of the Perth series (twelve years each).
LUNAR = r"\blunar\b|\byear\s+of\s+the\s+"
ANIMALS = r"\b(rat|ox|tiger|rabbit|dragon|snake|horse|goat|monkey|rooster|dog|pig)\b"
LUNAR_STARTS = {"I": 1996, "II": 2008, "III": 2020}
#: How fractions of an ounce are written in a search.
FRACTIONS = {0.5: "1/2", 0.25: "1/4", 0.1: "1/10", 0.05: "1/20"}
#: Fixed value: parts that the listings of a series are dealt into.
PARTS = 64
#: Offers at a fixed price.
FIXED_PRICE = r"(?i)fixed|buyitnow|bin"


def perth_lunar(series: Column) -> Column:
    low = F.lower(series)
    return F.coalesce((low.rlike(LUNAR) | low.rlike(ANIMALS)) & low.rlike(r"\bperth\b|\baustralian?\b"), F.lit(False))


def lunar_number(series: Column) -> Column:
    """I, II or III, if a series names its number; else null."""
    found = F.upper(F.regexp_extract(F.lower(series), r"series\s*(i{1,3}|[123])", 1))
    return F.when(found.isin("I", "1"), "I").when(found.isin("II", "2"), "II").when(found.isin("III", "3"), "III")


def lunar_start(series: Column) -> Column:
    """The first of the twelve years of a Perth lunar series; without a number, but with an animal, the
    second series'. Null for all others."""
    out = F.when(F.lit(False), 0)
    for number, year in LUNAR_STARTS.items():
        out = out.when(lunar_number(series) == number, year)
    return F.when(perth_lunar(series), out.when(F.lower(series).rlike(ANIMALS), LUNAR_STARTS["II"]))


def by_grade(series: Column) -> Column:
    """Bullion coins, whose matrix has grades for columns."""
    return classes.bullion_series(series) & ~classes.bar_series(series)


def mode(series: Column) -> Column:
    return F.when(classes.bar_series(series), "brand").when(classes.bullion_series(series), "grade").otherwise("mint")


def keywords(series: Column, weight: Column, grade: Column) -> Column:
    """What is searched for: countries for adjectives, a whole lunar series for one of its animals, the size
    (one ounce for bullion coins unless another is given) and the word proof."""
    plain = reduce(lambda s, d: F.regexp_replace(s, rf"(?i)\b{d[0]}\b", d[1]), DEMONYMS.items(), series)
    metal = F.coalesce(*[F.when(F.lower(series).rlike(rf"\b{m}\b"), m) for m in ("gold", "silver", "platinum", "palladium")], F.lit("silver"))
    perth = perth_lunar(series)
    words = F.when(perth, F.concat_ws(" ", F.lit("Perth Lunar"), F.concat(F.lit("Series "), lunar_number(series)), metal)).otherwise(plain)
    size = F.coalesce(F.nullif(weight, F.lit(0.0)), F.when(by_grade(series), F.lit(1.0)))
    written = F.when(F.lit(False), "")
    for ounces, name in FRACTIONS.items():
        written = written.when(size == ounces, name)
    whole = F.when(size == F.floor(size), F.floor(size).cast("string")).otherwise(size.cast("string"))
    size = F.when(size.isNotNull() & (size != 1), F.concat(written.otherwise(whole), F.lit(" oz"))).when((size == 1) | perth, "1 oz")
    words = F.concat_ws(" ", words, size)
    asked = F.regexp_replace(F.lower(grade), r"[\s-]", "") == "proof"
    return F.when(F.coalesce(asked, F.lit(False)) & ~F.lower(words).contains("proof"), F.concat(words, F.lit(" Proof"))).otherwise(words)


def has_grade(title: Column, wanted: Column) -> Column:
    """Whether a title has the wanted grade; any for null, All and what is no grade. Proof alone is a word."""
    norm = F.regexp_replace(F.upper(F.regexp_replace(wanted, r"[\s-]", "")), "^PF", "PR")
    parts = norm.rlike(r"^(MS|PR|SP|AU|XF|EF|VF|F|VG|G|AG|PO)[0-9]{1,2}\+?$")
    return F.when(norm == "PROOF", F.lower(title).rlike(r"\bproof\b")).when(parts, F.coalesce(text.grade(title) == norm, F.lit(False))).otherwise(True)


def kept(listings: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The rows of ``listings`` that belong into their series' matrix: series, mode, year (0: none), axis, sold, price (null unless above 0), url.

    ``listings`` has series, grade (wanted), title, sold (boolean), listing_type, total, url and at (a timestamp). Sales are of the
    last ``days``, offers at a fixed price. Lunar coins are of their series' years, bullion coins not older than
    their series and no small change. Coins without a year and rows without a series are
    left out, bars have no year. What a series says is found once for each series."""
    s = F.col("series")
    of_series = listings.select("series").distinct().withColumns({"mode": mode(s), "_start": lunar_start(s), "_first": classes.first_year(s)})
    # Few series have most rows, so each is dealt into parts: else one task would read all listings of a series.
    of_series = of_series.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.xxhash64("title", "url"), F.lit(PARTS)).cast("int")
    rows = listings.drop("mode", "_start", "_first").withColumn("_part", part).join(of_series, ["series", "_part"]).withColumns({"year": F.coalesce(text.year(F.col("title")), F.lit(0)), "sold": F.coalesce("sold", F.lit(False))})
    grade_mode = F.col("mode") == "grade"
    early = F.coalesce((F.col("year") > 0) & (F.col("year") < F.col("_first")), F.lit(False))
    good = F.when(F.col("sold"), F.col("at").between(F.date_sub(as_of, days).cast("timestamp"), as_of)).otherwise(F.col("listing_type").isNull() | F.col("listing_type").rlike(FIXED_PRICE))
    good &= F.col("_start").isNull() | F.col("year").between(F.col("_start"), F.col("_start") + 11)
    good &= ~grade_mode | ~(early | F.coalesce(variants.small_change(F.col("title")), F.lit(False)))
    good &= (F.col("mode") == "brand") | (F.col("year") > 0)
    good &= (F.col("mode") != "mint") | has_grade(F.col("title"), F.col("grade"))
    axis = F.when(grade_mode, F.coalesce(text.grade(F.col("title")), F.lit("RAW"))).when(F.col("mode") == "mint", text.mint(F.col("title"))).otherwise(market.brand(F.col("title")))
    year = F.when(F.col("mode") == "brand", 0).otherwise(F.col("year"))
    return rows.where(F.coalesce(good, F.lit(False))).select("series", "mode", year.alias("year"), axis.alias("axis"), "sold", F.when(F.col("total") > 0, F.col("total")).alias("price"), "url")


def panels(listings: DataFrame, as_of: Column, days: int = 90, dates: DataFrame | None = None) -> DataFrame:
    """The cells of all series' matrices: series, mode, year (null for bars), axis, median, sold, cheapest, url, next_price, tier.

    ``listings`` as in ``kept``. Columns are brands of bars, grades of bullion coins, mints of others. median is that of the
    ``sold`` sales, cheapest and next_price are the two lowest offers (rows, so they may be equal), tier
    that of the key date (``dates`` as in ``ladders.key_dates``). A cell without any price above 0 stays, empty. Medians come from counts by
    distinct price and offers are cut to two before they are shuffled, so a hot cell is no large group. Titles are
    read once: what is kept of them is written between the stages."""
    keys = ["series", "mode", "year", "axis"]
    rows = staged(kept(listings, as_of, days), "listings")
    priced = F.col("price").isNotNull()
    cells = rows.groupBy(*keys).agg(F.count_if(F.col("sold") & priced).alias("sold"))
    w = Window.partitionBy(*keys)
    counts = robust.value_counts(rows.where("sold"), keys, "price").withColumns({"upto": F.sum("c").over(w.orderBy("price")), "n": F.sum("c").over(w)})
    middle = [F.min(F.when(F.col("upto") > F.floor(at / 2), F.col("price"))) for at in (F.col("n") - 1, F.col("n"))]
    medians = counts.groupBy(*keys).agg(money((middle[0] + middle[1]) / 2).alias("median"))
    offers = rows.where(~F.col("sold") & priced).withColumn("nth", F.row_number().over(w.orderBy("price", "url"))).where("nth <= 2")
    lowest = [F.max(F.when(F.col("nth") == nth, F.col(c))).alias(name) for nth, c, name in ((1, "price", "cheapest"), (1, "url", "url"), (2, "price", "next_price"))]
    cells = cells.join(medians, keys, "left").join(offers.groupBy(*keys).agg(*lowest), keys, "left").withColumn("year", F.nullif("year", F.lit(0)).cast("bigint"))
    out = ["series", "mode", "year", "axis", "median", "sold", "cheapest", "url", "next_price"]
    if dates is None:
        return cells.select(*out, F.lit(None).cast("string").alias("tier"))
    mint = F.when(F.col("mode") == "mint", F.col("axis")).otherwise("")
    return ladders.key_dates(staged(cells.select(*out, mint.alias("mint")), "cells"), dates).select(*out, "tier")


def panel_summaries(cells: DataFrame) -> DataFrame:
    """Each series' matrix in a row: mode, cells, priced (with any price), first_year, last_year, columns."""
    some = F.col("median").isNotNull() | F.col("cheapest").isNotNull()
    return cells.groupBy("series", "mode").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(some).alias("priced"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("axis").alias("columns")
    )
