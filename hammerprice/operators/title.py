"""A title taken apart, and a search put together from the parts.

Words after a minus sign are taken out first; grade, finish, set and proof then follow an
order in which each looks at what the ones before have found. Patterns are free of
look-around: what may not follow a word is blotted out before the word is looked for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import bars, dictionary

YEAR = r"\b(1[7-9][0-9]{2}|20[0-2][0-9])\b"
MINT_BY_YEAR = r"\b[0-9]{4}\s*-?\s*(cc|[sdpwo])\b"
MINT_ALONE = [r"(?:^|[\s-])(cc)\b", r"(?:\bmint\s*(?:mark)?:?\s*|\b(?:cent|dollar|dime|quarter|half|nickel|penny|eagle)\s+)([sdpwo])\b", r"\b([sdow])\s+mint\b"]
GRADE = r"\b(ms|pr|pf|sp|au|xf|ef|vf|f|vg|g|ag|po)\s*-?\s*([0-9]{1,2})(\+?)(?:[^a-z0-9_]|$)"
UNGRADED = r"\b(superb\s+gem\s+bu|gem\s+bu|choice\s+bu|bu|unc)\b"
DESIGNATION = r"\b(dcam|cam|pl|dpl|fb|fbl|fs|fh|rd|rb|bn)\b"
SET = r"\b(?:prestige|premier\s*silver|silver|clad)?\s*proof\s*set\b"
OUNCES = r"\b([0-9]+(?:\.[0-9]+)?)(?:/([0-9]+))?\s*(?:troy\s*)?oz\b"
GRAMS_IN_OUNCE = 31.1035
#: Grades by word, in the order in which they are looked for.
WORD_GRADES = [
    (r"\babout\s+uncirculated\b", "AU50"),
    (r"\bextremely\s+fine\b", "XF40"),
    (r"\bvery\s+fine\b", "VF20"),
    (r"\bvery\s+good\b", "VG8"),
    (r"\b(?:^|\s)fine\b", "F12"),  # not "fine silver"
    (r"\b(?:^|\s)good\b", "G4"),  # not "good luck" and the like
    (r"\bpoor\b", "PO1"),
]
#: What takes the meaning of a grade from a word, by grade.
BLOTS = {"F12": r"\bfine\s+silver", "G4": r"\bgood\s+(?:luck|condition|deal|price|quality)"}
#: Finishes, in the order in which they are looked for.
FINISHES = [
    ("Enhanced Reverse Proof", r"\benhanced\s+reverse\s+proof\b"),
    ("Reverse Proof", r"\breverse\s+proof\b"),
    ("Burnished", r"\bburnished\b"),
    ("Satin Finish", r"\bsatin\s+finish\b"),
    ("Antiqued", r"\bantiqued\b"),
    ("Gilded", r"\bgilded\b"),
    ("High Relief", r"\bhigh\s+relief\b"),
    ("Colorized", r"\bcolorized\b"),
    ("Colorized", r"\bcoloured\b"),
    ("Uncirculated", r"\buncirculated\b"),
]
#: Sets by what their name holds: kind and series.
SETS = [("prestige", "prestige", "US Prestige Proof Set"), ("premier", "premier-silver", "US Premier Silver Proof Set"), ("silver", "silver", "US Silver Proof Set"), ("", "clad", "US Proof Set")]
#: Fractions of an ounce as titles write them.
WEIGHT_WORDS = [(0.05, "twentieth"), (0.1, "tenth"), (0.25, "quarter"), (0.5, "half")]
METALS = ["gold", "silver", "platinum", "palladium", "copper"]
#: Names of series; the first that a title holds counts.
SERIES = [
    "semiquincentennial gold $5", "semiquincentennial $5 gold", "semiquincentennial gold coin", "semiquincentennial $2.50",
    "semiquincentennial silver dollar", "semiquincentennial silver medal", "semiquincentennial clad half", "semiquincentennial half dollar",
    "semiquincentennial nickel", "semiquincentennial dime", "semiquincentennial quarter", "semiquincentennial cent",
    "semiquincentennial gold", "semiquincentennial silver", "semiquincentennial medal", "semiquincentennial",
    "250th anniversary gold", "250th anniversary silver", "250th anniversary coin", "250th anniversary",
    "canadian silver maple leaf", "canadian gold maple leaf", "silver maple leaf", "gold maple leaf",
    "canadian silver maple", "canadian gold maple", "silver maple", "gold maple", "maple leaf", "maple",
    "mexican silver libertad", "mexican gold libertad", "silver libertad", "gold libertad", "libertad",
    "austrian silver philharmonic", "austrian gold philharmonic", "silver philharmonic", "gold philharmonic", "philharmonic",
    "british silver britannia", "british gold britannia", "perth mint lunar", "british lunar", "britannia lunar",
    "lunar britannia", "perth lunar", "australian lunar",
    "year of the rat", "year of the ox", "year of the tiger", "year of the rabbit", "year of the dragon", "year of the snake",
    "year of the horse", "year of the goat", "year of the monkey", "year of the rooster", "year of the dog", "year of the pig",
    "silver britannia", "gold britannia", "britannia", "chinese silver panda", "chinese gold panda", "silver panda", "gold panda", "panda",
    "silver kookaburra", "kookaburra", "gold kangaroo", "kangaroo", "nugget", "silver koala", "koala",
    "silver swan", "australian swan", "swan", "silver emu", "australian emu", "emu",
    "wedge-tailed eagle", "wedge tailed eagle", "wedge tail eagle", "silver quokka", "quokka", "super pit",
    "chinese myths and legends", "dragon and phoenix", "tiger and dragon", "silver krugerrand", "gold krugerrand", "krugerrand",
    "canadian silver polar bear", "silver polar bear", "polar bear", "canadian wildlife", "wildlife series",
    "canadian birds of prey", "birds of prey", "canadian predator", "predator series", "creatures of the north", "kraken", "werewolf", "mothman",
    "american gold buffalo", "gold buffalo", "american silver eagle", "american gold eagle", "american platinum eagle", "american palladium eagle",
    "silver eagle", "gold eagle", "platinum eagle", "palladium eagle",
    "saint gaudens double eagle", "st gaudens double eagle", "st. gaudens double eagle", "saint-gaudens", "saint gaudens", "st gaudens", "st. gaudens",
    "liberty head double eagle", "liberty double eagle", "double eagle", "indian head eagle", "indian eagle",
    "indian head quarter eagle", "indian quarter eagle", "indian head half eagle", "indian half eagle", "liberty head eagle", "liberty eagle",
    "liberty head half eagle", "liberty half eagle", "liberty head quarter eagle", "liberty quarter eagle",
    "walking liberty half", "walking liberty", "standing liberty quarter", "standing liberty",
    "seated liberty dollar", "seated liberty half", "seated liberty quarter", "seated liberty dime", "seated liberty",
    "indian head cent", "indian head penny", "indian head", "liberty nickel", "flowing hair", "capped bust", "draped bust", "trade dollar",
    "morgan", "peace", "barber", "mercury", "roosevelt", "washington quarter", "washington",
    "lincoln", "jefferson nickel", "jefferson", "buffalo nickel", "buffalo", "eisenhower", "ike", "kennedy half", "kennedy", "franklin half", "franklin",
    "shield", "ase", "sae", "wheat penny", "wheat cent", "steel penny", "steel cent",
    "half dollar", "quarter dollar", "quarter", "dime", "nickel", "dollar", "penny", "cent",
]
#: What stands before the name of a zodiac animal's year, by what the title says: mint, programme, metal.
ZODIAC = [
    [("Perth", r"\bperth\b"), ("Australian", r"\baustralian?\b"), ("Royal Mint", r"\broyal\s*mint\b"), ("RCM", r"\brcm\b|\broyal\s*canadian\b"), ("Chinese", r"\bchinese?\b")],
    [("Lunar", r"\blunar\b")],
    [("Silver", r"\bsilver\b"), ("Gold", r"\bgold\b"), ("Platinum", r"\bplatinum\b")],
]
#: Adjectives of series as searches write them.
COUNTRIES = [("Mexican", "Mexico"), ("Canadian", "Canada"), ("Australian", "Australia"), ("Austrian", "Austria"), ("British", "Great Britain"), ("Chinese", "China")]
FRACTIONS = [(0.5, "1/2"), (0.25, "1/4"), (0.1, "1/10"), (0.05, "1/20")]


def exclusions(title: Column) -> Column:
    """The words after a minus sign, in lower case."""
    return F.regexp_extract_all(F.lower(F.trim(title)), F.lit(r"(?:^|\s)-([a-z0-9_]+)"), F.lit(1))


def without_exclusions(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(title), r"(?:^|\s)-[a-zA-Z0-9_]+", " "), r"\s{2,}", " "))


def _found(low: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(low, pattern, group), F.lit(""))


def _upper(low: Column, pattern: str) -> Column:
    return F.upper(_found(low, pattern))


def _grades(low: Column) -> list[Column]:
    """Grade and where it is from (null: a number), before proof is looked for."""
    prefix = F.upper(F.regexp_extract(low, GRADE, 1))
    prefix = F.when(prefix == "PF", "PR").when(prefix == "EF", "XF").otherwise(prefix)
    number = F.when(low.rlike(GRADE), F.concat(prefix, F.regexp_extract(low, GRADE, 2), F.regexp_extract(low, GRADE, 3)))
    term = _found(low, UNGRADED)
    informal = F.when(term.rlike(r"superb\s+gem"), "MS67").when(term.contains("gem"), "MS65").when(term.contains("choice"), "MS63").when(term.isNotNull(), "MS60")
    word = F.when(F.lit(False), "")
    for pattern, grade in WORD_GRADES:
        blotted = F.regexp_replace(low, BLOTS[grade], "x") if grade in BLOTS else low
        word = word.when(blotted.rlike(pattern), grade)
    source = F.when(number.isNotNull(), F.lit(None)).when(informal.isNotNull(), "bu-term").when(word.isNotNull(), "word-grade")
    return [F.coalesce(number, informal, word), source]


def _weight(low: Column) -> Column:
    def number(pattern: str, group: int = 1, before: str = "") -> Column:
        return F.concat(F.lit(before), _found(low, pattern, group)).try_cast("double")

    whole = number(OUNCES) / F.nullif(F.coalesce(number(OUNCES, 2), F.lit(1.0)), F.lit(0.0))
    words = F.when(F.lit(False), 0.0)
    for value, word in WEIGHT_WORDS:
        words = words.when(low.rlike(rf"\b{word}\s*(?:troy\s*)?(?:oz|ounce)s?\b"), value)
    dotted, plain = number(r"(?:^|\s)\.([0-9]+)\s*(?:grams?|g)\b", before="0."), number(r"\b([0-9]+(?:\.[0-9]+)?)\s*(?:grams?|g)\b")
    half = F.when(low.rlike(r"\bhalf\s+gram\b"), 0.5)
    grams = [F.nullif(x, F.lit(0.0)) / GRAMS_IN_OUNCE for x in (dotted, plain, half)]
    return F.coalesce(F.nullif(whole, F.lit(0.0)), words, *grams, whole)


def parts(low: Column) -> list[Column]:
    """What a title in lower case, without exclusions, says but for its series: year, mint, grade,
    grade_number, grade_source, designation, finish, is_roll, set_type, set_series, label, weight,
    metal, bar_maker. Null where it says nothing."""
    year = _found(low, YEAR).cast("int")
    mint = F.coalesce(_upper(low, MINT_BY_YEAR), *[_upper(low, p) for p in MINT_ALONE])
    grade, source = _grades(low)
    finish = text.first_rule(F.regexp_replace(low, r"\buncirculated\s*set", "x"), [(name, p) for name, p in FINISHES])
    named = F.coalesce(_found(low, SET, 0), _found(low, r"\bmint\s*set\b", 0), _found(low, r"\buncirculated\s*set\b", 0))
    is_set = named.isNotNull()
    unstruck = is_set & ~named.rlike(r"proof\s*set")

    def of_set(nth: int, otherwise: str) -> Column:
        out = F.when(~is_set, F.lit(None)).when(unstruck, otherwise)
        for word, *names in SETS:
            out = out.when(named.contains(word), names[nth])
        return out

    struck = F.regexp_replace(low, r"\bproof\b[\s-]*like", "x").rlike(r"\bproof\b")
    proof = F.coalesce(~is_set & struck & finish.isNull() & (grade.isNull() | F.coalesce(source == "bu-term", F.lit(False))), F.lit(False))
    number = F.when(~proof, F.regexp_extract(grade, "([0-9]+)", 1).try_cast("int"))
    metal = text.first_rule(low, [(m, rf"\b{m}\b") for m in METALS])
    columns = {
        "year": year,
        "mint": mint,
        "grade": F.when(proof, "Proof").otherwise(grade),
        "grade_number": number,
        "grade_source": F.when(~proof, source),
        "designation": _upper(low, DESIGNATION),
        "finish": F.when(proof, "Proof").otherwise(finish),
        "is_roll": F.coalesce(low.rlike(r"\brolls?\b|\btubes?\b|\b[0-9]+\s*coin\s*roll\b"), F.lit(False)),
        "set_type": of_set(0, "mint-uncirculated"),
        "set_series": of_set(1, "US Mint Set"),
        "label": F.concat(F.lit("Type "), _found(low, r"\btype\s*([12])\b")),
        "weight": _weight(low),
        "metal": metal,
        "bar_maker": F.when(low.rlike(r"\bbars?\b"), bars.maker(low)),
    }
    return [c.alias(name) for name, c in columns.items()]


def series_table(df: DataFrame) -> DataFrame:
    """The built-in names (nth, name, shown) as a table; any other of this shape will do."""
    rows = [(i, name, re.sub(r"\b\w", lambda m: m[0].upper(), name)) for i, name in enumerate(SERIES)]
    return df.sparkSession.createDataFrame(rows, "nth int, name string, shown string")


def parsed(titles: DataFrame, title: str, names: DataFrame | None = None) -> DataFrame:
    """``titles`` with ``plain`` (the title without exclusions), ``exclusions``, the columns of ``parts``
    (set_series apart), ``bar_line`` and ``series``: the first name of ``names`` (nth, name, shown) that the
    title holds, else the set's. A year of an animal keeps what the title says of mint, programme and metal.

    Each distinct title is parsed and looked up once, so frequent ones cost as much as rare
    ones. A null title says nothing; columns of ``titles`` with the name of a part are
    replaced."""
    known = series_table(titles) if names is None else names
    own = titles.select(F.col(title).alias("_title")).distinct()
    own = own.select("_title", without_exclusions(F.col("_title")).alias("plain"), exclusions(F.col("_title")).alias("exclusions"))
    own = own.withColumn("_low", F.lower("plain"))
    own = own.select("*", *parts(F.col("_low"))).withColumn("bar_line", bars.line_in_search(F.col("bar_maker"), F.col("_low")))
    found = dictionary.first_held(own, known, "_low", "name", "nth")
    whole = own.join(found, "_low", "left")
    before = F.concat_ws(" ", *[text.first_rule(F.col("_low"), rules) for rules in ZODIAC])
    shown = F.when(F.col("name").startswith("year of the ") & (before != ""), F.concat_ws(" ", before, "shown")).otherwise(F.col("shown"))
    whole = whole.withColumn("series", F.coalesce(shown, "set_series")).drop("_low", "nth", "name", "shown", "set_series")
    kept = [c for c in titles.columns if c == title or c not in whole.columns]
    return titles.select(*kept).join(whole, F.col(title).eqNullSafe(F.col("_title")), "left").drop("_title")


def keywords(row: dict[str, Column], raw: Column, weight: Column, label: Column) -> Column:
    """A search from year, mint, series, finish, grade and designation of ``row``, weight and label, with
    the metals that it does not mean after a minus sign; ``raw`` where the series is unknown."""
    year = row["year"].cast("string")
    when = F.when(row["mint"].isNotNull(), F.concat_ws("-", year, row["mint"])).otherwise(year)
    series = row["series"]
    for adjective, country in COUNTRIES:
        series = F.regexp_replace(series, rf"(?i)\b{adjective}\b", country)
    proof = F.coalesce(row["grade"] == "Proof", F.lit(False))
    grade = F.when(~proof, row["grade"]).when(row["finish"].isNull(), "Proof")
    plain = F.regexp_replace(weight.cast("string"), r"\.0$", "")
    for value, fraction in FRACTIONS:
        plain = F.when(weight == value, fraction).otherwise(plain)
    weighed = F.when(weight != 0, F.concat(plain, F.lit(" oz")))
    given = F.array_compact(F.array(when, series, row["finish"], grade, row["designation"], weighed, F.nullif(label, F.lit(""))))
    joined = F.array_join(given, " ")
    gold, silver, platinum, palladium = (F.lower(joined).rlike(rf"\b{m}\b") for m in ("gold", "silver", "platinum", "palladium"))
    other = platinum | palladium
    less = F.array_compact(F.array(F.when(~silver & (other | gold), "-silver"), F.when(~gold & (other | silver), "-gold")))
    enough = series.isNotNull() & (F.size(given) + F.size(less) >= 2)
    whole = F.trim(F.concat_ws(" ", joined, F.nullif(F.array_join(less, " "), F.lit(""))))
    return F.when(enough, whole).otherwise(F.coalesce(F.nullif(raw, F.lit("")), whole))
