"""Small classes of series, keys and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import intent

#: Series that are priced by grade and not by year and mint, and bars.
BULLION = (
    r"\b(silver\s*eagle|gold\s*eagle|platinum\s*eagle|libertad|maple\s*leaf|philharmonic|britannia|krugerrand|panda|kookaburra|koala|kangaroo|gold\s+buffalo|buffalo\s+gold|silver\s+buffalo|buffalo\s+silver"
    r"|american\s+(gold|silver|platinum)|perth\s*mint|lunar|year\s+of\s+the|polar\s*bear|gold\s+bar|silver\s+bar|platinum\s+bar|bullion\s+bar)\b"
)
BAR = r"\b(gold|silver|platinum|palladium)\s+bar\b"
#: The first year of a bullion series.
FIRST_YEARS = {
    "libertad": 1982, "silver eagle": 1986, "gold eagle": 1986, "platinum eagle": 1997, "maple leaf": 1979, "philharmonic": 1989, "britannia": 1987,
    "krugerrand": 1967, "panda": 1982, "kookaburra": 1990, "koala": 2007, "kangaroo": 1986, "gold buffalo": 2006, "polar bear": 2018,
}
#: The series that a search means, by pattern; the first that fits counts.
PREMIUM_SERIES = [
    ("Gold Krugerrand", r"\bgold krugerrand\b"),
    ("Silver Krugerrand", r"\bsilver krugerrand\b"),
    ("Krugerrand", r"\bkrugerrand\b"),
    ("American Gold Eagle", r"\bamerican gold eagle\b|\bgold eagle\b"),
    ("American Silver Eagle", r"\bamerican silver eagle\b|\bsilver eagle\b"),
    ("American Gold Buffalo", r"\bamerican (gold )?buffalo\b|\bgold buffalo\b"),
    ("Canadian Gold Maple Leaf", r"\bcanad(a|ian) gold maple\b|\bgold maple leaf\b"),
    ("Canadian Silver Maple Leaf", r"\bcanad(a|ian) silver maple\b|\bsilver maple leaf\b"),
    ("Chinese Gold Panda", r"\bchinese gold panda\b|\bgold panda\b"),
    ("Chinese Silver Panda", r"\bchinese (silver )?panda\b|\bsilver panda\b"),
    ("Mexican Gold Libertad", r"\bmexican gold libertad\b|\bgold libertad\b"),
    ("Mexican Silver Libertad", r"\bmexican silver libertad\b|\bsilver libertad\b"),
    ("British Silver Britannia", r"\bbritish silver britannia\b|\bsilver britannia\b"),
    ("Austrian Silver Philharmonic", r"\baustrian silver philharmonic\b|\bsilver philharmonic\b"),
    ("Australian Silver Kookaburra", r"\baustralian silver kookaburra\b|\bsilver kookaburra\b"),
    ("Lunar", r"\b(perth )?lunar\b"),
    ("American Platinum Eagle", r"\bamerican platinum eagle\b|\bplatinum eagle\b"),
]
#: Coins of the anniversary year and the series that they belong to.
ANNIVERSARY = {
    "semiquincentennial half dollar": "Kennedy Half Dollar",
    "semiquincentennial clad half": "Kennedy Half Dollar",
    "semiquincentennial quarter": "Washington Quarter",
    "semiquincentennial dime": "Roosevelt Dime",
    "semiquincentennial nickel": "Jefferson Nickel",
    "semiquincentennial cent": "Lincoln Cent",
}
#: Keys that are refreshed before all others.
FAST_LANE = r"(libertad|panda|american\s+silver\s+eagle|silver\s+eagle|perth|\brcm\b|royal\s+canadian\s+mint|maple\s+leaf)"


def _is(x: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(x).rlike(pattern), F.lit(False))


def bullion_series(series: Column) -> Column:
    return _is(series, BULLION)


def bar_series(series: Column) -> Column:
    return _is(series, BAR)


def first_year(series: Column) -> Column:
    """The first year of a bullion series; null for others."""
    first = F.when(F.lit(False), 0)
    for name, began in FIRST_YEARS.items():
        first = first.when(F.contains(F.lower(series), F.lit(name)), began)
    return first


def too_early(series: Column, year: Column) -> Column:
    """Whether a coin is older than its bullion series: circulating money of that name."""
    return F.coalesce(year < first_year(series), F.lit(False))


def premium_series(query: Column) -> Column:
    """The series of a search as the rows of usual premiums name it; null for others. Krugerrands are gold and
    lunar coins silver unless the search says otherwise."""
    low = F.lower(query)
    found = text.first_rule(low, PREMIUM_SERIES)
    other = F.when(low.contains("silver"), "Silver Krugerrand").otherwise("Gold Krugerrand")
    lunar = F.when(low.contains("gold"), "Gold Lunar").otherwise("Silver Lunar")
    return F.when(found == "Krugerrand", other).when(found == "Lunar", lunar).otherwise(found)


def anniversary_series(series: Column) -> Column:
    """The circulating series of an anniversary coin; null for others."""
    low = F.trim(F.lower(series))
    out = F.when(F.lit(False), "")
    for name, own in ANNIVERSARY.items():
        out = out.when(low == name, own)
    return out


def generic_key(key: Column) -> Column:
    return _is(key, r"[_\s]generic\z")


def fast_lane(key: Column, composition: Column, metal: Column, depth: Column) -> Column:
    """Silver bullion with data enough that is refreshed first."""
    return F.coalesce((depth == "viable") & (metal == "silver") & composition.startswith("bullion"), F.lit(False)) & _is(key, FAST_LANE)


def with_file(keys: DataFrame, files: DataFrame) -> DataFrame:
    """``keys`` (key, ...) with ``has_file``: whether a file of ``files`` (file) has the key's canonical form or its set
    of words, adjectives as countries. Both are look-ups of one column, so no name is compared with another."""
    stem = F.regexp_replace("file", r"\.csv$", "")
    forms = files.select(text.search_key(F.translate(stem, "_", " ")).alias("_form")).distinct().withColumn("_a", F.lit(True))
    words = files.select(intent.word_set(F.translate(stem, "_-", "  ")).alias("_words")).distinct().withColumn("_b", F.lit(True))
    rows = keys.withColumns({"_form": text.search_key(F.col("key")), "_words": intent.word_set(F.translate("key", "_-", "  "))})
    out = rows.join(forms, "_form", "left").join(words, "_words", "left")
    return out.select(*keys.columns, (F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("has_file"))
