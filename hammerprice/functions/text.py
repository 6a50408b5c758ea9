"""Expressions over titles and search terms. Patterns are free of look-around, so that
the same text runs in any SQL engine; word bounds are ASCII."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"\b(1[7-9][0-9]{2}|20[0-4][0-9])\b"
GRADE = r"\b(ms|pr|pf|sp|au|xf|ef|vf|vg|ag|fr|po)[ -]*([0-9]{1,2}[+]?)"

#: Rewrites of a search term, in the order that they are applied.
KEY_STEPS = [
    (r"(^|\s)-[a-z]+", " "),
    (r"\b([0-9]{4})-0\b", "$1 o"),
    (r"\b([0-9]{4})-(cc|d|s|o|w|p)\b", "$1 $2"),
    (r"\b(ms|pr|pf|sp|au|xf|ef|vf|vg|ag|fr|po)\s*-\s*([0-9]{1,2})\b", "$1$2"),
    (r"\b(1/20|0[.]05)\s*oz\b|\b120oz\b", "twentieth oz"),
    (r"\b(1/10|0[.]1)\s*oz\b|\b110oz\b", "tenth oz"),
    (r"\b(1/4|0[.]25)\s*oz\b|\b14oz\b", "quarter oz"),
    (r"\b(1/2|0[.]5)\s*oz\b|\b12oz\b", "half oz"),
    (r"\bone\s+(troy\s+)?(ounce|oz)\b", "1oz"),
    (r"\b([0-9]+([/.][0-9]+)?)\s*(troy\s*)?oz\b", "$1oz"),
    (r"\b(united\s+states(\s+of\s+america)?|u[.]s([.]a)?|usa|us)\b[.]?", "american"),
    (r"\b(united\s+kingdom|great\s+brit(ain|ian))\b", "british"),
    (r"\bmexico\b", "mexican"),
    (r"\bchina\b", "chinese"),
    (r"\broyal\s+mint\b", "royalmint"),
    (r"\b(i{1,3}|iv|v)\b", ""),
    (r"[^a-z0-9\s-]", ""),
]

#: Words of titles that are no single item.
DENIED = [
    "lots?",
    "collection",
    "estate",
    "replica",
    "copy",
    "cleaned",
    "polished",
    "fake",
    "token",
    "plated",
    "album",
    "folder",
    "whitman",
    "dansco",
    "littleton",
    "map",
    "push.?pin",
    "rings?",
    "necklace",
    "pendant",
    "bracelet",
    "cufflinks?",
    "buckle",
    "keychain",
    "earrings?",
    "magnet",
    "poster",
    "ornament",
    "button",
    "shirt",
    "patch",
    "book",
    "encyclopedia",
    "catalog(ue)?",
    "medal",
    r"coin\s*roll\s*hunt(ing)?",
]
ROLLS = r"\b(rolls?|tubes?)\b"

#: Denominations, the first that a text has counts.
DENOMINATIONS = [("half dollar", r"\bhalf\s*dollar"), ("quarter", r"\bquarter"), ("dime", r"\bdime"), ("nickel", r"\bnickel"), ("cent", r"\b(cent|penny|pennies)\b"), ("dollar", r"\bdollar")]
METALS = ["gold", "silver", "platinum", "palladium", "copper"]


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule whose pattern the text holds."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def search_key(text: Column) -> Column:
    """The canonical key of a search term: rewritten, then distinct words in order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = reduce(lambda s, step: F.regexp_replace(s, *step), KEY_STEPS, low)
    low = F.when(low.rlike(r"\bkrugerrand\b"), F.regexp_replace(low, r"\bsouth\s*african?\b", "")).otherwise(low)
    return F.array_join(F.array_sort(F.array_distinct(tokens(low))), " ")


def year(text: Column) -> Column:
    """The first year from 1700 to 2049."""
    found = F.regexp_extract(text, YEAR, 1)
    return F.when(found != "", found.cast("int"))


def years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda x: x.cast("int"))


def grade(text: Column) -> Column:
    """``MS65`` and the like; PF counts as PR; null if none."""
    low = F.lower(text)
    found = F.concat(F.upper(F.regexp_extract(low, GRADE, 1)), F.regexp_extract(low, GRADE, 2))
    return F.when(found != "", F.regexp_replace(found, "^PF", "PR"))


def mint(text: Column) -> Column:
    """The mint mark beside a year, else CC, else P."""
    near = F.upper(F.regexp_extract(F.lower(text), r"\b[0-9]{4}[ -]?(cc|d|s|o|w|p)\b", 1))
    return F.when(near != "", near).when(F.lower(text).rlike(r"\bcc\b"), F.lit("CC")).otherwise(F.lit("P"))


def metal(text: Column) -> Column:
    """The metal that a text names; null for none and for several without a fineness."""
    low = F.lower(text)
    hits = [low.rlike(rf"\b{m}\b") for m in METALS]
    count = sum((h.cast("int") for h in hits), F.lit(0))
    fine = F.when(low.rlike(r"\b(22|24)k\b|[.]9167"), F.lit("gold")).when(low.rlike(r"[.]925|\b90%"), F.lit("silver"))
    one = F.coalesce(*[F.when(h, F.lit(m)) for h, m in zip(hits, METALS)])
    return F.when(count > 1, F.coalesce(fine, F.when(low.rlike(r"\bgold\s+(plated|gilded)\b"), F.lit("silver")))).otherwise(F.coalesce(one, fine))


_OZ = r"[0-9][0-9./]*\s*(?:troy\s*)?oz"
#: What makes the gold of a title that names silver too a decoration, in the order in which it is looked for.
DECORATIONS = [
    r"\bgold[\s-]*(gild|plat|finish|color|dust|marble|rutil|rhodium|ton(e[ds]?|ing))",
    r"\bgold[\s-]*(spartan|back|creek|hill)\b",
    r"\bmulti[\s-]*metal\b",
    r"\b(ruthenium|rhodium|black)\b",
    r"[.]?999[+]?\s*(fine\s+)?silver\b",
    r"\bfine\s+silver\b",
]
#: Phrases that tell silver in a title taken for gold, and gold in one taken for silver.
OPPOSITES = {"gold": r"[.]999\s*silver|\bsilver\s+(coin|panda|eagle|bullion)\b|\b[0-9]+\s*yuan\b.*silver", "silver": r"[.]999\s*gold|\bgold\s+(coin|panda|eagle|bullion)\b|\b[0-9]+\s*yuan\b.*\bgold\b"}


def title_metal(title: Column) -> Column:
    """The metal that a listing is made of: of gold and silver the one beside its weight, silver where gold
    is a decoration, else the first of ``METALS`` that the title names; null for none."""
    low = F.lower(title)

    def weighed(metal: str) -> Column:
        return low.rlike(rf"\b{_OZ}\s+{metal}\b|\b{metal}\s+{_OZ}\b")

    both = low.rlike(r"\bgold\b") & low.rlike(r"\bsilver\b")
    gold, silver = weighed("gold"), weighed("silver")
    decorated = reduce(lambda a, b: a | b, [low.rlike(p) for p in DECORATIONS])
    first = first_rule(low, [(m, rf"\b{m}\b") for m in METALS])
    return F.when(both & silver & ~gold, "silver").when(both & gold & ~silver, "gold").when(both & decorated, "silver").otherwise(first)


#: Cities and their mint marks, the first that a title names counts.
CITIES = [("CC", "carson city"), ("D", "denver"), ("P", "philadelphia"), ("S", "san francisco"), ("W", "west point")]


def stated_mints(title: Column) -> Column:
    """All mint marks that a title states, as an array: beside a year, both of an over-mintmark, else its city, else CC."""
    low = F.lower(F.coalesce(title, F.lit("")))
    year, over = r"\b[0-9]{4}\s*-?\s*(cc|[sdpwo])\b", r"\b[0-9]{4}\s*-?\s*([sdpwo])\s*(?:/|over)\s*([sdpwo])\b"
    near = F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(g)) for p, g in ((year, 1), (over, 1), (over, 2))])
    city = first_rule(low, CITIES)
    cc = F.coalesce(title, F.lit("")).rlike(r"\bCC\b")
    other = F.when(city.isNotNull(), F.array(city)).when(cc, F.array(F.lit("CC"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(near) > 0, F.array_distinct(F.transform(near, lambda m: F.upper(m)))).otherwise(other)


def grade_numbers(title: Column) -> Column:
    """The numbers of all grades that a title states, as an array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"\b(ms|pr|pf|sp|au|xf|ef|vf|vg|ag|fr|po)\s*-?\s*([0-9]{1,2})\b"), F.lit(2))
    return F.transform(found, lambda n: n.cast("int"))


#: Fractions of an ounce by word.
OUNCES = [("twentieth", 0.05), ("tenth", 0.1), ("quarter", 0.25), ("half", 0.5)]


def weight(text: Column) -> Column:
    """Troy ounces that a text names (ounces, fractions, words, grams, kilos); null for none or over 200."""
    low = F.lower(text)
    fraction = r"\b([0-9]+)/([0-9]+)\s*(troy\s*)?(oz|ounce|onza)"
    plain = r"\b([0-9]+([.][0-9]+)?)\s*(troy\s*)?(ozt|oz|ounces?|onzas?)\b"
    grams, kilos = r"\b([0-9]+([.][0-9]+)?)\s*(g|grams?)\b", r"\b([0-9]+([.][0-9]+)?)\s*(kg|kilos?)\b"

    def number(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(low, pattern, group).try_cast("double")

    out = F.when(low.rlike(fraction), number(fraction) / F.nullif(number(fraction, 2), F.lit(0.0)))
    for name, value in OUNCES:
        out = out.when(low.rlike(rf"\b{name}\s*(oz|ounce)"), F.lit(value))
    out = out.when(low.rlike(plain), number(plain)).when(low.rlike(kilos), number(kilos) * 32.1507).when(low.rlike(grams), number(grams) / 31.1035)
    return F.when(out <= 200, out)


def denied(title: Column, allow_roll: bool = False) -> Column:
    """Whether a title is no single item; rolls and tubes are let through if allowed."""
    pattern = r"\b(" + "|".join(DENIED) + r")\b"
    stamp = F.regexp_replace(F.lower(title), r"\bstamps?\s*(die|error|double|over|variet)", "").rlike(r"\bstamps?\b")
    out = F.lower(title).rlike(pattern) | stamp
    return F.coalesce(out if allow_roll else out | F.lower(title).rlike(ROLLS), F.lit(False))


def denomination(text: Column) -> Column:
    return first_rule(F.lower(text), DENOMINATIONS)


def exclusions(text: Column) -> Column:
    """The words after a minus sign."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?:^|\s)-([a-z]+)"), F.lit(1))


def fingerprint(title: Column, total: Column, day: Column) -> Column:
    """First 80 letters and digits of the title, whole total and date, by bars."""
    plain = F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), 1, 80)
    return F.concat_ws("|", plain, F.floor(total + 0.5).cast("string"), F.date_format(day, "yyyy-MM-dd"))


def pool(title: Column, condition: Column | None = None, certification: Column | None = None) -> Column:
    """raw, graded, proof or reverse-proof: by condition code, then certification, then title."""
    low = F.lower(title)
    slab = low.rlike(r"\b(pcgs|ngc|anacs|icg)\b") | grade(title).isNotNull()
    out = F.when(low.rlike(r"\breverse\s*proof\b"), F.lit("reverse-proof"))
    out = out.when(F.regexp_replace(low, r"proof[- ]?like", "").rlike(r"\bproof\b"), F.lit("proof"))
    if condition is not None:
        out = out.when(condition == "2000", F.lit("graded"))
    if certification is not None:
        out = out.when(F.lower(certification).rlike("pcgs|ngc|anacs|icg"), F.lit("graded")).when(F.lower(certification).rlike("uncertified|raw"), F.lit("raw"))
    return out.when(slab, F.lit("graded")).otherwise(F.lit("raw"))
