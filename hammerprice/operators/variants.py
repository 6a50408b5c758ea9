"""Finishes, series and metal contents that exclude each other, as expressions over titles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

#: Words of a title that tell a finish family; proof and reverse proof are patterns.
FAMILIES = {
    "colorized": ["colorized", "coloured", "colorised", "enameled", "enamelled", "painted", "full color", "full-colour", "spot color", "spot-colour"],
    "gilded": ["gilded", "guilded", "gold plated", "gold-plated", "golden finish", "gilt"],
    "privy": ["privy"],
    "highRelief": ["high relief", "uhr"],
    "antiqued": ["antiqued", "antique finish"],
    "burnished": ["burnished"],
    "specialtyEdition": ["elite libertad", "libertad traders", "traders convention"],
}
REVERSE_PROOF = r"\breverse[\s-]+proof\b"
#: Families that may be asked for.
REQUESTABLE = ["colorized", "antiqued", "gilded", "burnished", "highRelief"]

#: Series of one denomination that are never the same item.
CONFLICTS = [
    (r"\bjefferson\b", r"\bbuffalo\b"),
    (r"\bjefferson\b", r"\bliberty\s+nickel\b"),
    (r"\bjefferson\b", r"\bshield\s+nickel\b"),
    (r"\bbuffalo\b", r"\bliberty\s+nickel\b"),
    (r"\bkennedy\b", r"\bfranklin\b"),
    (r"\bkennedy\b", r"\bwalking\s*liberty\b"),
    (r"\bkennedy\b", r"\bbarber\b"),
    (r"\bkennedy\b", r"\bseated\s*liberty\b"),
    (r"\bfranklin\b", r"\bwalking\s*liberty\b"),
    (r"\bfranklin\b", r"\bbarber\b"),
    (r"\bwalking\s*liberty\b", r"\bbarber\b"),
    (r"\bwashington\b", r"\bstanding\s*liberty\b"),
    (r"\bwashington\b", r"\bbarber\b"),
    (r"\bwashington\b", r"\bseated\s*liberty\b"),
    (r"\bstanding\s*liberty\b", r"\bbarber\b"),
    (r"\broosevelt\b", r"\bmercury\b"),
    (r"\broosevelt\b", r"\bbarber\b"),
    (r"\bmercury\b", r"\bbarber\b"),
    (r"\bmorgan\b", r"\bpeace\b"),
    (r"\bmorgan\b", r"\beisenhower\b"),
    (r"\bmorgan\b", r"\bsacagawea\b"),
    (r"\bpeace\b", r"\beisenhower\b"),
    (r"\blincoln\b", r"\bindian\s*head\b"),
    (r"\bwheat\b", r"\bindian\s*head\b"),
]

#: The last year of silver coins by denomination, and words that tell silver.
SILVER = [
    ("quarter", 1964, ["silver", "90%", ".900"]),
    ("dime", 1964, ["silver", "90%", ".900"]),
    ("half dollar", 1970, ["silver", "90%", "40%", ".900", ".400"]),
    ("nickel", 1945, ["silver", "35%", "war"]),
]
#: Small change that shares key words with bullion, and what marks bullion.
CHANGE = r"\b(centavos?|pesos?|[0-9]+\s*cent(avo)?)\b"
BULLION = r"\b(oz|ounce|onza|troy|bullion)\b"


def has_any(low: Column, words: list[str]) -> Column:
    return reduce(or_, [low.contains(w) for w in words])


def families(title: Column) -> Column:
    """The finish families that a title names, as an array; "proof-like" is no proof."""
    low = F.lower(F.coalesce(title, F.lit("")))
    reverse = low.rlike(REVERSE_PROOF)
    proof = F.regexp_replace(low, r"\bproof[\s-]*like", "").rlike(r"\bproof\b") & ~reverse
    named = [F.when(reverse, "reverseProof"), F.when(proof, "proof"), *[F.when(has_any(low, words), name) for name, words in FAMILIES.items()]]
    return F.array_compact(F.array(*named))


def requested_family(wanted: Column) -> Column:
    """The family that a search asks for: null for none, "ambiguous" for several."""
    asked = F.array_intersect(F.array(*map(F.lit, REQUESTABLE)), families(wanted))
    return F.when(F.size(asked) > 1, "ambiguous").otherwise(F.get(asked, F.lit(0)))


def variant_mismatch(title: Column, requested: Column, wants_proof: Column) -> Column:
    """The rule by which a title's finish removes it: ``variantMismatch`` where no family is asked
    for (titles without a family, with a privy mark alone, and proofs for those who want them
    stay), ``variantWrongColor`` where one is (raw titles of just that family stay); else null."""
    own = families(title)
    special = F.array_contains(own, "specialtyEdition")
    plain = (F.size(own) == 0) | (own == F.array(F.lit("privy")))
    proof = wants_proof & F.arrays_overlap(own, F.array(F.lit("proof"), F.lit("reverseProof")))
    others = F.array_remove(F.array_intersect(own, F.array(*map(F.lit, REQUESTABLE))), requested)
    same = (text.pool(title) == "raw") & ~special & F.array_contains(own, requested) & (F.size(others) == 0)
    out = F.when(requested.isNull() & ~(plain | (~special & proof)), "variantMismatch")
    return out.when(requested.isNotNull() & ~F.coalesce(same, F.lit(False)), "variantWrongColor")


def series_conflict(wanted: Column, title: Column) -> Column:
    """Whether a title names a series that excludes the wanted one, and not that one as well."""
    w, t = F.lower(wanted), F.lower(title)
    apart = [(w.rlike(a) & t.rlike(b) & ~t.rlike(a)) | (w.rlike(b) & t.rlike(a) & ~t.rlike(b)) for a, b in CONFLICTS]
    return F.coalesce(reduce(or_, apart), F.lit(False))


def composition_mismatch(title: Column, wanted: Column, year: Column) -> Column:
    """Silver titles for clad years and the other way round, by the denomination of ``wanted``.

    In clad years a search that names silver wants silver. War nickels go with any metal, other
    nickels with no silver. Unknown years and denominations remove nothing."""
    low, asked = F.lower(title), F.lower(wanted)
    kind = text.denomination(wanted)
    out = F.when(F.lit(False), F.lit(False))
    for name, last, words in SILVER:
        silver = has_any(low, words)
        if name == "nickel":
            out = out.when(kind == name, ~year.between(1942, last) & silver)
            continue
        out = out.when((kind == name) & (year > last), F.when(has_any(asked, words), ~silver).otherwise(silver))
        out = out.when(kind == name, low.rlike(r"\bclad\b|\bcopper[\s-]*nickel\b") & ~asked.rlike(r"\bclad\b"))
    return F.coalesce(out, F.lit(False))


def small_change(title: Column) -> Column:
    """Circulating coins that only share their name with bullion."""
    low = F.lower(title)
    return low.rlike(CHANGE) & ~low.rlike(BULLION)


def lacks_words(title: Column, words: Column) -> Column:
    """Whether a word of ``words`` (separated by blanks) is missing in the title as a whole word."""
    there = F.split(F.regexp_replace(F.lower(title), "[^a-z0-9_]+", " "), " ")
    wanted = F.filter(F.split(F.regexp_replace(F.lower(words), "[^a-z0-9_]+", " "), " "), lambda w: w != "")
    return ~F.forall(wanted, lambda w: F.array_contains(there, w))
