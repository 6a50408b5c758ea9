"""Match scores of listings: points for and against, each term by itself, 100 at most, no floor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from . import variants

#: Mint marks by city.
CITIES = [("carson city", "CC"), ("denver", "D"), ("philadelphia", "P"), ("san francisco", "S"), ("west point", "W")]
#: Words that tell an issue of a mint, and work by others.
ISSUED = ["united states mint", "u.s. mint", "us mint", "west point", "perth mint", "royal canadian mint", "royal mint", "banco de mexico", "casa de moneda", "original mint packaging"]
ISSUED_WORDS = r"\b(rcm|coa|omp)\b"
ISSUED_COLORIZED = ["perth mint", "royal canadian mint", "royal mint", "pcgs colorized", "ngc colorized"]
ISSUED_COLORIZED_WORDS = r"\b(rcm|coa)\b"
ALTERED = ["novelty", "custom", "art coin", "hand painted", "hand-painted", "gold plated", "gold-plated", "overlay", "altered"]
ALTERED_COLORIZED = ["novelty", "painted by", "custom", "art coin", "hand painted", "hand-painted", "overlay", "altered"]
SINGLE = r"\b(penny|pennies|cents?|nickels?|dimes?|quarters?|half\s*dollars?|dollar\s*coin)\b"


def stated_mint(title: Column) -> Column:
    """The mint that a title states: the mark after a year, a city, or CC in capitals; else null."""
    low = F.lower(title)
    near = F.upper(F.regexp_extract(low, r"\b[0-9]{4}\s*-?\s*(cc|[sdpwo])\b", 1))
    out = F.when(near != "", near)
    for city, mark in CITIES:
        out = out.when(low.contains(city), mark)
    return out.when(title.rlike(r"\bCC\b"), "CC")


def points(holds: Column, yes: int, no: int = 0) -> Column:
    return F.when(holds, yes).otherwise(no)


def _grade(title: Column, low: Column, grade: Column) -> Column:
    """Exact grades, slabs and distance of the numbers, and uncirculated terms."""
    g, joined = F.regexp_replace(F.lower(grade), r"\s+", ""), F.regexp_replace(low, r"\s+", "")
    same = joined.contains(g) | joined.contains(F.regexp_replace(g, "^ef", "xf")) | joined.contains(F.regexp_replace(g, "^xf", "ef"))
    wanted = F.regexp_extract(g, "([0-9]+)", 1).try_cast("int")
    stated = F.regexp_extract(low, r"\b(ms|pr|pf|sp|au|xf|ef|vf|vg|ag|fr|po)\s*-?\s*([0-9]{1,2})\b", 2).try_cast("int")
    off = F.abs(wanted - stated)
    far = F.when(off >= 3, -40).when(off == 2, -30).when(off == 1, -20).otherwise(0)
    fresh = points(g.rlike("bu|unc") & low.rlike(r"\b(bu|unc|uncirculated|brill|brilliant)\b"), 10)
    return F.when(grade.isNotNull(), F.when(same, 15).when(low.rlike("pcgs|ngc|anacs|icg"), 5 + far).otherwise(0) + fresh).otherwise(0)


def _finish(low: Column, family: Column, wants_proof: Column) -> Column:
    own = variants.families(low)
    others = F.array_remove(F.array_intersect(own, F.array(*map(F.lit, variants.REQUESTABLE))), family)
    there = F.coalesce(F.array_contains(own, family) & (F.size(others) == 0), F.lit(False))
    proof = F.arrays_overlap(own, F.array(F.lit("proof"), F.lit("reverseProof")))
    plain = (F.size(own) == 0) | (own == F.array(F.lit("privy"))) | (wants_proof & proof)
    unasked = F.when(F.array_contains(own, "colorized"), -30).when(~plain, -20).otherwise(0)
    asked = points(there & ~F.array_contains(own, "specialtyEdition"), 5, -30)
    colour = family == "colorized"
    altered = F.when(colour, variants.has_any(low, ALTERED_COLORIZED)).otherwise(variants.has_any(low, ALTERED))
    issued = F.when(colour, variants.has_any(low, ISSUED_COLORIZED) | low.rlike(ISSUED_COLORIZED_WORDS)).otherwise(variants.has_any(low, ISSUED) | low.rlike(ISSUED_WORDS))
    origin = F.when(there & altered, -10).when(there & issued, 10).otherwise(0)
    return F.when(family.isNull(), unasked).otherwise(asked + origin)


def coin(title: Column, wanted: dict[str, Column]) -> Column:
    """Score of a title. Known fields of ``wanted``: year, grade, mint, series, query, metal, weight,
    price and spot (per ounce), designation, finish, animal, set_type, found_series and bar_series,
    and the booleans roll, proof, set, lunar. Terms whose fields are absent or null give nothing;
    without ``query`` no finish family is asked for, without ``grade`` raw items are."""
    low, w = F.lower(F.coalesce(title, F.lit(""))), wanted
    none, no = F.lit(None).cast("string"), F.lit(False)
    grade, series, asked = w.get("grade", none), w.get("series", none), w.get("query", none)
    is_set = F.coalesce(w.get("set", no), no)
    wants_proof = F.coalesce(w.get("proof", no), no) | F.coalesce(F.lower(grade).rlike("^(proof|pr|pf)"), no) | F.coalesce(w.get("finish", none) == "Proof", no)
    has_proof = low.rlike(r"\bproof\b")
    pool = text.pool(title)
    subject = F.coalesce(series, asked)
    terms = [F.lit(50), points(low.rlike(r"\bpcgs\b"), 5), _grade(title, low, grade)]
    terms.append(F.when(wants_proof & ~has_proof, -25).when(~wants_proof & has_proof & ~is_set, -25).otherwise(0))
    terms.append(F.when(grade.isNotNull(), points(pool != "graded", -20)).otherwise(points(pool.isin("graded", "proof"), -25)))
    terms.append(_finish(low, variants.requested_family(asked), wants_proof))
    terms.append(points(variants.series_conflict(series, low), -50))
    terms.append(points(F.coalesce(text.denomination(low) != text.denomination(subject), no), -40))
    if "roll" in w:
        terms.append(F.when(w["roll"], points(low.rlike(text.ROLLS), 15, -30)).otherwise(0))
    if "year" in w:
        there = text.years(low)
        terms.append(F.when(F.array_contains(there, w["year"]), 15).when(w["year"].isNotNull() & (F.size(there) > 0), -30).otherwise(0))
        terms.append(points(variants.composition_mismatch(low, subject, w["year"]), -40))
    if "mint" in w:
        stated = stated_mint(title)
        terms.append(F.when(stated == F.upper(w["mint"]), 10).when(stated != F.upper(w["mint"]), -30).otherwise(0))
    if "series" in w:
        words = F.split(F.lower(series), r"\s+")
        hits = F.size(F.filter(words, lambda x: (F.length(x) > 2) & low.contains(x)))
        terms.append(F.when(hits >= F.ceil(F.size(words) * 0.6), 10).when(hits == 0, -25).otherwise(0))
    if "bar_series" in w and "found_series" in w:
        terms.append(points(w["found_series"] == w["bar_series"], 10))
    if "metal" in w:
        found = text.title_metal(low)
        terms.append(F.when(found == w["metal"], 10).when(found != w["metal"], -30).otherwise(0))
    if "designation" in w:
        there = ~variants.lacks_words(low, w["designation"])
        terms.append(F.when(wants_proof & w["designation"].isNotNull(), points(there, 10, -15)).otherwise(0))
    if "set" in w:
        has_set, kind = low.rlike(r"\bset\b"), w.get("set_type", none)
        wrong = F.when(kind == "mint-uncirculated", has_proof & ~low.rlike(r"\bmint\b")).when(kind.contains("proof"), low.rlike(r"\bmint\s+set\b") & ~has_proof)
        terms.append(F.when(is_set, points(has_set, 15, -35) + points(low.rlike(SINGLE) & ~has_set, -25) + points(F.coalesce(wrong, no), -20)).otherwise(0))
    if "animal" in w:
        terms.append(points(low.contains(F.lower(w["animal"])), 5))
    if "lunar" in w:
        terms.append(points(w["lunar"] & low.rlike(r"\blunar\b"), 3))
    if "weight" in w:
        found = text.weight(low)
        off = F.abs(found - w["weight"]) / F.greatest(found, w["weight"])
        terms.append(F.when(w["weight"].isNull(), 0).when(found.isNull(), -15).otherwise(points(off < 0.05, 25, -35)))
        if "spot" in w and "price" in w:
            terms.append(points((w["weight"] < 1) & found.isNull() & (w["price"] > w["spot"] * w["weight"] * 5), -20))
    return F.least(F.lit(100), sum(terms[1:], terms[0]))


def bar(title: Column, wanted: dict[str, Column]) -> Column:
    """Score of a bar's title. Known fields: brand, size, metal, condition, year, animal,
    series_number, found_series and bar_series, and the boolean lunar."""
    low, w = F.lower(F.coalesce(title, F.lit(""))), wanted
    terms = [F.lit(50), points(low.rlike(r"\bbar\b"), 5)]
    if "brand" in w:
        terms.append(F.when(w["brand"].isNull(), 0).otherwise(points(low.contains(F.lower(w["brand"])), 20, -25)))
    if "size" in w:
        joined, size = F.regexp_replace(low, r"\s+", ""), F.regexp_replace(F.lower(w["size"]), r"\s+", "")
        grams = F.regexp_extract(size, r"^([0-9]+([.][0-9]+)?)gram", 1).try_cast("double")
        plain = F.regexp_replace(grams.cast("string"), "[.]0$", "")
        half = (grams == 0.5) & joined.rlike("1/2g|halfgram")
        terms.append(points(joined.contains(size) | joined.contains(F.concat(plain, F.lit("g"))) | half, 15))
    for name, yes in (("metal", 10), ("year", 5), ("animal", 5)):
        if name in w:
            terms.append(points(low.contains(F.lower(w[name].cast("string"))), yes))
    if "condition" in w:
        terms.append(points((w["condition"] == "sealed") & low.rlike("sealed|assay"), 5))
    if "lunar" in w:
        terms.append(points(w["lunar"] & low.rlike(r"\blunar\b"), 5))
    if "bar_series" in w and "found_series" in w:
        terms.append(F.when(w["bar_series"].isNull(), 0).otherwise(points(w["found_series"] == w["bar_series"], 10, -15)))
    if "series_number" in w:
        said = F.regexp_extract(low, r"\bseries\s*([0-9]+)\b", 1)
        terms.append(points(said == w["series_number"].cast("string"), 5))
    return F.least(F.lit(100), sum(terms[1:], terms[0]))
