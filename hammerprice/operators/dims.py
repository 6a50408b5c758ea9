"""Dimension rules: calendars, rolls, premiums, catalogue types, mintages and auction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import money, rarity

#: The animals of twelve years from 2020 on.
ANIMALS = ["Rat", "Ox", "Tiger", "Rabbit", "Dragon", "Snake", "Horse", "Goat", "Monkey", "Rooster", "Dog", "Pig"]
#: Pattern and pieces of a roll or tube, the first that a text has counts.
ROLLS = [
    (r"silver\s*eagle", 20),
    (r"gold\s*eagle", 20),
    (r"gold\s*buffalo", 20),
    (r"maple\s*leaf", 25),
    (r"britannia", 25),
    (r"libertad", 25),
    (r"philharmonic", 20),
    (r"krugerrand", 25),
    (r"kangaroo", 25),
    (r"kookaburra", 20),
    (r"panda", 30),
    (r"lunar", 20),
    (r"polar\s*bear", 25),
    (r"half\s*dollar|kennedy|franklin|walking\s*liberty|barber\s*half|seated.*half", 20),
    (r"quarter|standing\s*liberty", 40),
    (r"dime|mercury|roosevelt|barber\s*dime|seated.*dime", 50),
    (r"nickel|jefferson|buffalo\s*nickel|liberty.*nickel", 40),
    (r"cent|penny|lincoln|indian\s*head|wheat", 50),
    (r"dollar|morgan|peace|eisenhower|susan.*anthony|sacagawea", 20),
]
#: Usual premium over melt value (from, to) and the condition of its row, over metal,
#: series, form and weight (ounces, 0 if unknown); the first that holds counts.
PREMIUMS = [
    ("gold-eagle-1oz", 0.04, 0.12, "series = 'American Gold Eagle' and weight = 1"),
    ("gold-eagle-frac", 0.08, 0.25, "series = 'American Gold Eagle' and weight < 1"),
    ("gold-buffalo-1oz", 0.04, 0.12, "series = 'American Gold Buffalo' and weight = 1"),
    ("gold-maple-1oz", 0.03, 0.10, "series = 'Canadian Gold Maple Leaf' and weight = 1"),
    ("gold-krugerrand-1oz", 0.03, 0.10, "series = 'Gold Krugerrand' and weight = 1"),
    ("gold-panda-1oz", 0.05, 0.20, "series = 'Chinese Gold Panda' and weight >= 0.9"),
    ("gold-libertad-1oz", 0.08, 0.40, "series = 'Mexican Gold Libertad' and weight = 1"),
    ("gold-coin-frac-other", 0.08, 0.30, "metal = 'gold' and form <> 'bar' and weight > 0 and weight < 1"),
    ("gold-coin-1oz-other", 0.03, 0.15, "metal = 'gold' and form <> 'bar' and weight = 1"),
    ("gold-bar-1g", 0.12, 0.40, "metal = 'gold' and form = 'bar' and weight <= 0.04"),
    ("gold-bar-small", 0.05, 0.20, "metal = 'gold' and form = 'bar' and weight < 0.5"),
    ("gold-bar-1oz", 0.02, 0.08, "metal = 'gold' and form = 'bar' and weight >= 0.5"),
    ("silver-eagle-1oz", 0.25, 0.80, "series = 'American Silver Eagle' and weight = 1"),
    ("silver-maple-1oz", 0.15, 0.50, "series = 'Canadian Silver Maple Leaf' and weight = 1"),
    ("silver-krugerrand-1oz", 0.15, 0.50, "series = 'Silver Krugerrand' and weight = 1"),
    ("silver-britannia-1oz", 0.15, 0.50, "series = 'British Silver Britannia' and weight = 1"),
    ("silver-philharmonic-1oz", 0.15, 0.50, "series = 'Austrian Silver Philharmonic' and weight = 1"),
    ("silver-panda-30g", 0.20, 0.80, "series = 'Chinese Silver Panda'"),
    ("silver-libertad-1oz", 0.30, 1.50, "series = 'Mexican Silver Libertad' and weight = 1"),
    ("silver-kookaburra-1oz", 0.20, 0.80, "series = 'Australian Silver Kookaburra' and weight = 1"),
    ("silver-lunar-1oz", 0.20, 1.00, "lower(series) like '%lunar%' and metal = 'silver' and weight = 1"),
    ("silver-coin-1oz-other", 0.10, 0.60, "metal = 'silver' and form <> 'bar' and weight = 1"),
    ("silver-round-1oz", 0.08, 0.30, "metal = 'silver' and form = 'round' and weight = 1"),
    ("silver-bar-1oz", 0.08, 0.30, "metal = 'silver' and form = 'bar' and weight = 1"),
    ("silver-bar-10oz", 0.05, 0.20, "metal = 'silver' and form = 'bar' and weight between 5 and 15"),
    ("silver-bar-100oz", 0.03, 0.12, "metal = 'silver' and form = 'bar' and weight >= 90"),
    ("platinum-eagle-1oz", 0.05, 0.20, "series = 'American Platinum Eagle' and weight = 1"),
    ("platinum-coin-1oz-other", 0.04, 0.20, "metal = 'platinum' and weight = 1"),
    ("palladium-1oz", 0.04, 0.20, "metal = 'palladium' and weight = 1"),
]


def animal(year: Column) -> Column:
    """The animal of a year from 1996 on."""
    return F.when(year >= 1996, F.get(F.array(*map(F.lit, ANIMALS)), F.pmod(year - 2020, F.lit(12)).cast("int")))


def lunar_series(year: Column) -> Column:
    return F.when(year.between(1996, 2007), "I").when(year.between(2008, 2019), "II").when(year.between(2020, 2031), "III")


def roll_quantity(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for pattern, n in ROLLS:
        out = out.when(F.lower(text).rlike(pattern), n)
    return out


def with_premium(df: DataFrame) -> DataFrame:
    """``df`` (metal, series, form, weight) with ``band``: struct key, low, high of the first row that
    holds, null for none or without a metal."""
    plain = {"metal": F.lower("metal"), "series": F.coalesce("series", F.lit("")), "form": F.coalesce("form", F.lit("")), "weight": F.coalesce(F.col("weight").cast("double"), F.lit(0.0))}
    rows = df.select(F.struct(*df.columns).alias("_row"), *[c.alias(n) for n, c in plain.items()])  # the conditions read the plain values under these names
    band = F.when(F.col("metal").isNull(), F.lit(None))
    for key, low, high, condition in PREMIUMS:
        band = band.when(F.expr(condition), F.struct(F.lit(key).alias("key"), F.lit(low).alias("low"), F.lit(high).alias("high")))
    return rows.select("_row", band.alias("_band")).select("_row.*", F.col("_band").alias("band"))


def premium_verdict(value: Column, melt: Column, band: Column) -> Column:
    """low, normal, high or unknown; premiums are compared to six places, bounds are normal."""
    def exact(x: Column) -> Column:
        return x.cast("decimal(18,6)")

    premium = exact(F.when(melt > 0, (value - melt) / melt))
    return F.when(premium.isNull() | band.isNull(), "unknown").when(premium < exact(band["low"]), "low").when(premium > exact(band["high"]), "high").otherwise("normal")


def best_type(items: DataFrame, types: DataFrame) -> DataFrame:
    """item_id, type_id, score: the catalogue type that fits an item best.

    ``items``: item_id, words (array), year, metal. ``types``: type_id, title, first, last,
    metal. Points: 20 for the year, 5 for each word of three letters or more in the title, 10
    for the metal. Only types that share a word with the item are scored (an inverted index
    over words); ties go to the smallest type_id, a number. Shared words are counted once for
    each set of words, scores once for each such set, year and metal, and the best is an
    aggregate, so pairs are summed where they arise and never shuffled."""
    long = F.array_sort(F.filter(F.array_distinct("words"), lambda w: F.length(w) > 2))
    q = items.withColumn("words", long)
    word = types.select("type_id", F.explode(F.array_distinct(F.split(F.lower("title"), r"\s+"))).alias("_word"))
    asked = q.select("words").distinct()
    hits = asked.select("words", F.explode("words").alias("_word")).join(word, "_word").groupBy("words", "type_id").agg(F.count(F.lit(1)).alias("_hits"))
    rated = hits.join(types.select("type_id", "first", "last", F.col("metal").alias("_metal")), "type_id")
    score = F.when(F.col("year").between(F.col("first"), F.col("last")), 20).otherwise(0) + F.col("_hits") * 5 + F.when(F.col("metal") == F.col("_metal"), 10).otherwise(0)
    profiles = q.select("words", "year", "metal").distinct()
    best = profiles.join(rated, "words").groupBy("words", "year", "metal").agg(F.max(F.struct(score.cast("int").alias("score"), (-F.col("type_id")).alias("_id"))).alias("_best"))
    same = q.words.eqNullSafe(best.words) & q.year.eqNullSafe(best.year) & q.metal.eqNullSafe(best.metal)
    return q.join(best.select(best.words, best.year, best.metal, "_best"), same).select("item_id", (-F.col("_best._id")).alias("type_id"), F.col("_best.score").alias("score"))


def cell_rarity(cells: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` with mintage and rarity; of several issues of one key the largest known mintage counts."""
    one = issues.groupBy(*keys).agg(F.max("mintage").alias("mintage"))
    return cells.join(one, keys, "left").withColumn("rarity", rarity(F.col("mintage")))


def auction_stats(records: DataFrame, keys: list[str]) -> DataFrame:
    """count, median, high, low, mean, houses (sorted), first and last day of records (house, day, price); prices of zero don't count."""
    p = F.when(F.col("price") > 0, F.col("price"))
    out = records.groupBy(*keys).agg(F.count(p).alias("count"), money(F.median(p)).alias("median"), F.max(p).alias("high"), F.min(p).alias("low"), money(F.sum(p.cast("decimal(18,2)")).cast("double") / F.count(p)).alias("mean"), F.array_sort(F.collect_set("house")).alias("houses"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return out
